"""The eight comparison approaches over descriptor tables.

inputs: labels (image_id, class); sift, cnn, vit (image_id, local_idx, vec); cnn_global, vit_global (image_id, vec).
Which tables an approach needs is in APPROACHES. Every run gives one row per classifier (and strategy) with all
metrics; nb_vw is null where no vocabulary has a size (shown as RAS).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.arrow import with_columns
from wordloom.operators import candidates, cluster, positional, selection, stats, vocabulary
from wordloom.operators.classify import classify
from wordloom.operators.evaluation import comparison_table, evaluate, stratified_split, with_proba_map
from wordloom.plans.config import Config
from wordloom.session import materialise
from wordloom.sources import networks

Inputs = dict[str, DataFrame]


def dense_vectors(occ: DataFrame, k: int) -> DataFrame:
    """image_id, vec: counts over their image's sum, by word id."""
    shares = stats.l1_normalised(occ).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", "share"))).alias("m"))
    return shares.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


def _split(inputs: Inputs, c: Config) -> DataFrame:
    return materialise(stratified_split(inputs["labels"], c.runtime.test_size, c.runtime.seed))


def _evaluated(train: DataFrame, test: DataFrame, c: Config, approach: str, variant: str, nb_vw: int | None) -> DataFrame:
    out = None
    train, test = materialise(train), materialise(test)
    for name in c.classifiers.enabled:
        p = classify(name, train, test, c.runtime.seed, c.classifiers.naive_bayes_variant, c.classifiers.knn_k)
        p = p.withColumn("classifier", F.lit(name))
        out = p if out is None else out.unionByName(p)
    by = ["dataset", "approach", "feature_variant", "classifier", "nb_vw"]
    p = materialise(with_proba_map(out).withColumns({"dataset": F.lit(c.data.dataset_name), "approach": F.lit(approach), "feature_variant": F.lit(variant), "nb_vw": F.lit(nb_vw if nb_vw is not None else -1)}))
    wide = evaluate(p, by, c.runtime.metrics or None).groupBy(*by).pivot("metric").agg(F.first("value"))
    return wide.withColumn("nb_vw", F.when(F.col("nb_vw") >= 0, F.col("nb_vw")))


def _sides(vectors: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = vectors.join(split, "image_id").withColumnRenamed("class", "label")
    return tuple(x.where(F.col("is_test") == side).select("image_id", "label", "vec") for side in (False, True))


def _train_rows(d: DataFrame, split: DataFrame) -> DataFrame:
    return d.join(split.where(~F.col("is_test")).select("image_id"), "image_id", "left_semi")


def bag_of_words(inputs: Inputs, c: Config, approach: str, tag: str) -> DataFrame:
    split = _split(inputs, c)
    words = materialise(vocabulary.build_vocabulary(_train_rows(inputs[tag], split), c.vocabulary.k, c.vocabulary.seed, c.vocabulary.max_iter, batch=c.vocabulary.batch))
    occ = vocabulary.encode(inputs[tag], words)
    return _evaluated(*_sides(dense_vectors(occ, c.vocabulary.k), split), c, approach, "full", c.vocabulary.k)


def clustered(d: DataFrame, c: Config) -> DataFrame:
    """Survivors of reduction and density clustering: image_id, local_idx, cluster_id, prob."""
    reduced = cluster.reduce(d, c.reduction.method, c.reduction.dim, c.reduction.neighbours, c.reduction.min_dist, c.runtime.seed)
    got = stats.survivors(cluster.density_clusters(reduced, c.density.min_cluster_size, c.density.min_samples))
    return materialise(got)


def selected_words(inputs: Inputs, c: Config, approach: str, tag: str) -> DataFrame:
    split = _split(inputs, c)
    train = materialise(_train_rows(inputs[tag], split))
    rows = clustered(train, c)
    if not rows.limit(1).count():
        raise ValueError("no descriptor survived clustering")
    occ = stats.occurrence(rows.withColumnRenamed("cluster_id", "word_id"))
    dense = materialise(stats.densified(stats.class_word(occ, inputs["labels"]), stats.class_size(occ, inputs["labels"])))
    out = None
    for name in c.selection.strategies:
        chosen = selection.select_top_n(selection.scores(dense, [name]), c.selection.n_candidates_per_class).withColumnRenamed("word_id", "cluster_id")
        if c.selection.mode == "weighted":
            pool = candidates.weighted_pool(chosen, rows, c.selection.candidate_pool_size or rows.count())
        else:
            pool = candidates.legacy_pool(chosen, rows)
        words = materialise(vocabulary.build_vocabulary(candidates.gather(pool, train), c.vocabulary.k, c.vocabulary.seed, c.vocabulary.max_iter, "cosine", c.vocabulary.batch))
        occ_all = vocabulary.encode(inputs[tag], words, "cosine")
        one = _evaluated(*_sides(dense_vectors(occ_all, c.vocabulary.k), split), c, approach, name, c.vocabulary.k)
        out = one if out is None else out.unionByName(one)
    return out


def mean_pool(images: DataFrame) -> DataFrame:
    """The plain tail: a synthetic image's vector is the mean over its positions."""
    x = images.select("strategy", "class", "j", F.posexplode("vec").alias("dim", "x"))
    m = x.groupBy("strategy", "class", "j", "dim").agg(F.avg("x").alias("x"))
    return m.groupBy("strategy", "class", "j").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("d")).select("strategy", "class", "j", F.col("d.x").alias("vec"))


def network_tail(images: DataFrame, kind: str, settings: dict) -> DataFrame:
    """The rest of a network behind its local layer, over the positions of each synthetic image in order: the same space as
    the real images' global vectors. All images have the network's number of positions, so a row's list is bounded."""
    x = images.groupBy("strategy", "class", "j").agg(F.sort_array(F.collect_list(F.struct("position", "vec"))).alias("p"))
    x = x.select("strategy", "class", "j", F.size("p").alias("n"), F.flatten("p.vec").alias("vec"))

    def work(n, vec):
        out: list = []
        for at in range(0, len(n), 32):
            flat = [np.asarray(v, np.float32).reshape(m, -1) for v, m in zip(vec.slice(at, 32).to_pylist(), n.slice(at, 32).to_pylist())]
            out += list(networks.network(kind, **settings).tail(np.stack(flat)))
        return [pa.array(out, pa.list_(pa.float32()))]

    return with_columns(x, [F.col("n"), F.col("vec")], "vec array<float>", work).drop("n")


def reconstructed(inputs: Inputs, c: Config, approach: str, tag: str, tail: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Training on synthetic images alone, testing on the real images' global vectors. Without a tail the network's own
    follows, if the configuration names its weights (or allows seeded ones), else the mean over positions."""
    settings = c.features.network(tag)
    tail = tail or (partial(network_tail, kind=tag, settings=settings) if settings is not None else mean_pool)
    split = _split(inputs, c)
    train = materialise(_train_rows(inputs[tag], split))
    rows = clustered(train, c).select("image_id", F.col("local_idx").alias("position"), F.col("cluster_id").alias("word_id"), "prob")
    labels = split.where(~F.col("is_test")).select("image_id", "class")
    classes, positions = labels.select("class").distinct(), train.select(F.col("local_idx").alias("position")).distinct()
    n = c.selection.images_per_class or positional.default_synthetic_count(labels.count(), classes.count())
    words = materialise(positional.position_words(rows, labels, c.selection.position_top_n, c.selection.strategies))
    reps = positional.representatives(rows, words)
    dim = len(train.select("vec").first()["vec"])
    images = positional.with_vectors(positional.synthetic(words, reps, classes, positions, n), train, dim)
    made = materialise(tail(images))
    _, test = _sides(inputs[f"{tag}_global"], split)
    out = None
    for name in c.selection.strategies:
        synth = made.where(F.col("strategy") == name).select(F.concat_ws("_", "class", "j").alias("image_id"), F.col("class").alias("label"), "vec")
        one = _evaluated(synth, test, c, approach, name, None)
        out = one if out is None else out.unionByName(one)
    return out


def end_to_end(inputs: Inputs, c: Config, approach: str, tag: str) -> DataFrame:
    return _evaluated(*_sides(inputs[f"{tag}_global"], _split(inputs, c)), c, approach, "global", None)


APPROACHES: dict[str, Callable[[Inputs, Config], DataFrame]] = {
    "bovw_baseline": partial(bag_of_words, approach="bovw_baseline", tag="sift"),
    "bovw_cvws": partial(selected_words, approach="bovw_cvws", tag="sift"),
    "cnn_bovw": partial(bag_of_words, approach="cnn_bovw", tag="cnn"),
    "cnn_bovw_cvws": partial(reconstructed, approach="cnn_bovw_cvws", tag="cnn"),
    "vit_bovw": partial(bag_of_words, approach="vit_bovw", tag="vit"),
    "vit_cvws": partial(reconstructed, approach="vit_cvws", tag="vit"),
    "cnn_end_to_end": partial(end_to_end, approach="cnn_end_to_end", tag="cnn"),
    "vit_end_to_end": partial(end_to_end, approach="vit_end_to_end", tag="vit"),
}


def run(name: str, inputs: Inputs, c: Config) -> DataFrame:
    if name not in APPROACHES:
        raise ValueError(f"no approach {name!r}; there are {sorted(APPROACHES)}")
    return comparison_table(APPROACHES[name](inputs, c))


def run_all(inputs: Inputs, c: Config, names: list[str] | None = None) -> DataFrame:
    out = None
    for name in names or list(APPROACHES):
        one = run(name, inputs, c)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return comparison_table(out)


def run_datasets(many: dict[str, Inputs], c: Config, name: str) -> DataFrame:
    """One approach over several datasets, rows tagged by dataset."""
    import copy

    out = None
    for dataset, inputs in sorted(many.items()):
        own = copy.deepcopy(c)
        own.data.dataset_name = dataset
        one = run(name, inputs, own)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return comparison_table(out)

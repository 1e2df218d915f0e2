"""Classifiers. knn and gaussian_nb are relational; the others wrap the ML library.

Tables: image_id, label (string), vec (array). Results: image_id, true_label, predicted_label, proba.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.functions.arrow import matrix, squared
from wordloom.functions.vectors import wide

#: Bytes of training vectors that a task holds at a time.
KNN_BYTES = 16 << 20


def _near(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """image_id, true_label, d, t_id, t_label: the k nearest training rows of every test row in every block of training rows.
    Both sides are dealt to a grid of cells; a cell holds its training rows as a matrix, test rows stream by."""
    spark = train.sparkSession
    dim, n, m = (train.select(F.size("vec")).first() or [1])[0], train.count(), test.count()
    rows = max(1, KNN_BYTES // (8 * max(1, dim)))
    blocks = max(1, -(-n // rows))
    groups = max(-(-m // rows), -(-2 * spark.sparkContext.defaultParallelism // blocks), 1)
    side = lambda df, own, others, is_test, cell: df.select(F.lit(is_test).alias("is_test"), F.col("image_id").alias("id"), F.col("label"), wide(F.col("vec")).alias("vec"), F.pmod(F.xxhash64("image_id"), F.lit(own)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other")).select(cell.alias("cell"), "is_test", "id", "label", "vec").where("vec is not null")
    both = side(train, blocks, groups, 0, F.col("own") * groups + F.col("other")).unionByName(side(test, groups, blocks, 1, F.col("other") * groups + F.col("own")))
    dealt = both.repartition(min(blocks * groups, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4), "cell").sortWithinPartitions("cell", "is_test")
    schema = f"image_id {test.schema['image_id'].dataType.simpleString()}, true_label {test.schema['label'].dataType.simpleString()}, d double, t_id {train.schema['image_id'].dataType.simpleString()}, t_label {train.schema['label'].dataType.simpleString()}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for batch in batches:
            cell, is_test = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, labels, x = batch.column(2).to_pylist(), batch.column(3).to_pylist(), matrix(batch.column(4))
            edges = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (is_test[1:] != is_test[:-1]), [True])))
            out: list[tuple] = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if cell[s] != now:
                    now, held, known = cell[s], [], None
                if not is_test[s]:
                    held.append((x[s:e], ids[s:e], labels[s:e]))
                elif held:
                    if known is None:
                        a = np.concatenate([h[0] for h in held])
                        known = a, (a * a).sum(axis=1), [i for h in held for i in h[1]], [v for h in held for v in h[2]]
                    for at in range(s, e, 256):
                        out += _block(x[at : min(at + 256, e)], ids[at:e], labels[at:e], known, k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _block(x: np.ndarray, ids: list, labels: list, known: tuple, k: int) -> list[tuple]:
    """The product selects, the distances themselves decide."""
    a, norms, t_ids, t_labels = known
    d, error = squared(x, a, norms)
    kth = np.partition(d, min(k, len(a)) - 1, axis=1)[:, min(k, len(a)) - 1]
    out = []
    for r in range(len(x)):
        few = np.flatnonzero(d[r] <= kth[r] + 2 * error[r] + 2e-9)
        exact = np.round(((x[r] - a[few]) ** 2).sum(axis=1), 9).tolist()
        out += [(ids[r], labels[r], v, i, t_labels[j]) for v, i, j in sorted(zip(exact, [t_ids[j] for j in few], few.tolist()))[:k]]
    return out


def knn(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Majority of the k nearest training rows; distances count to 9 places, ties go to the smaller id, then votes to
    the smaller label. Each block of training rows keeps its k best, so no task sees all pairs."""
    order = W.partitionBy("image_id").orderBy("d", "t_id")
    best = _near(train, test, k)
    votes = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("image_id", "true_label", "t_label").agg(F.count(F.lit(1)).alias("v"))
    tops = votes.groupBy("image_id", "true_label").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("v"), F.col("t_label").alias("l")))).alias("votes"),
        F.sum("v").alias("n"),
    )
    proba = F.map_from_entries(F.transform("votes", lambda x: F.struct(x["l"], -x["v"] / F.col("n"))))
    return tops.select("image_id", "true_label", F.col("votes")[0]["l"].alias("predicted_label"), proba.alias("proba"))


def gaussian_nb(train: DataFrame, test: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """Per class mean and variance by dimension (variances plus a share of the largest variance of all), log
    likelihoods plus log priors; ties go to the smaller label."""
    x = train.select("label", F.posexplode(wide(F.col("vec"))).alias("dim", "x"))
    spread = x.groupBy("dim").agg(F.var_pop("x").alias("v")).agg((F.max("v") * smoothing).alias("eps"))
    moments = x.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).join(spread)
    priors = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("prior", F.log(F.col("n") / F.sum("n").over(W.partitionBy())))
    model = moments.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "m", (F.col("v") + F.col("eps")).alias("v")))).alias("d")).join(priors, "label")
    z = F.zip_with(wide(F.col("vec")), F.col("d"), lambda a, p: -0.5 * (F.log(2 * np.pi * p["v"]) + (a - p["m"]) * (a - p["m"]) / p["v"]))
    scored = test.select("image_id", F.col("label").alias("true_label"), "vec").join(model).select("image_id", "true_label", F.col("label").alias("l"), (F.aggregate(z, F.lit(0.0), lambda s, t: s + t) + F.col("prior")).alias("s"))
    g = scored.groupBy("image_id", "true_label").agg(F.sort_array(F.collect_list(F.struct((-F.round("s", 9)).alias("s"), "l"))).alias("c"))
    e = F.transform("c", lambda q: F.struct(q["l"].alias("l"), F.exp(F.col("c")[0]["s"] - q["s"]).alias("p")))
    g = g.withColumn("e", e).withColumn("t", F.aggregate("e", F.lit(0.0), lambda s, q: s + q["p"]))
    return g.select("image_id", "true_label", F.col("c")[0]["l"].alias("predicted_label"), F.map_from_entries(F.transform("e", lambda q: F.struct(q["l"], q["p"] / F.col("t")))).alias("proba"))


def random_features(df: DataFrame, dim: int, gamma: float, n: int = 256, seed: int = 42) -> DataFrame:
    """vec by n random Fourier features of the radial kernel exp(-gamma |x - y|^2)."""
    r = np.random.default_rng(seed)
    w, b = r.normal(0, np.sqrt(2 * gamma), (dim, n)), r.uniform(0, 2 * np.pi, n)
    shared = df.sparkSession.sparkContext.broadcast((w, b))
    names = [c for c in df.columns if c != "vec"]
    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in names] + ["vec array<double>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(len(names)).flatten().to_numpy().reshape(batch.num_rows, -1)
                z = np.sqrt(2.0 / len(b)) * np.cos(x @ w + b)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(list(z), pa.list_(pa.float64()))], names=[*names, "vec"])

    return df.select(*names, wide(F.col("vec")).alias("vec")).mapInArrow(run, schema)


CLASSIFIERS = ("mlp", "svc", "decision_tree", "knn", "logistic_regression", "xgboost", "naive_bayes", "random_forest")


def classify(name: str, train: DataFrame, test: DataFrame, seed: int = 42, variant: str = "gaussian", k: int = 5, boosting_rounds: int = 20) -> DataFrame:
    """Fit by name on train, predict test. svc is a linear machine on random radial features with a softmax of its
    margins; xgboost is `boosting_rounds` rounds of boosted trees, one class against the rest; both stand in for what has no equal here."""
    if name not in CLASSIFIERS:
        raise ValueError(f"no classifier {name!r}; there are {CLASSIFIERS}")
    if name == "knn":
        return knn(train, test, k)
    if name == "naive_bayes" and variant == "gaussian":
        return gaussian_nb(train, test)
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dim = len(train.select("vec").first()["vec"])
    n = train.count()
    if name == "svc":
        var = train.select(F.posexplode(wide(F.col("vec"))).alias("d", "x")).agg(F.var_pop("x")).first()[0] or 1.0
        train, test = (random_features(t, dim, 1.0 / (dim * var), seed=seed) for t in (train, test))
    prepared = [t.select("image_id", "label", array_to_vector(wide(F.col("vec"))).alias("features")) for t in (train, test)]
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(prepared[0])
    classes = indexer.labels
    if name == "naive_bayes" and train.where(F.exists("vec", lambda v: v < 0)).limit(1).count():
        raise ValueError("multinomial naive Bayes needs features that are not negative; set classifiers.naive_bayes_variant=gaussian")
    kinds = {
        "mlp": lambda: C.MultilayerPerceptronClassifier(layers=[dim, 100, max(2, len(classes))], seed=seed, labelCol="y"),
        "svc": lambda: C.OneVsRest(classifier=C.LinearSVC(maxIter=100), labelCol="y", rawPredictionCol="rawPrediction"),
        "decision_tree": lambda: C.DecisionTreeClassifier(maxDepth=30, minInstancesPerNode=1, seed=seed, labelCol="y"),
        "logistic_regression": lambda: C.LogisticRegression(family="multinomial", maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, labelCol="y"),
        "xgboost": lambda: C.OneVsRest(classifier=C.GBTClassifier(maxIter=boosting_rounds, seed=seed), labelCol="y", rawPredictionCol="rawPrediction"),
        "naive_bayes": lambda: C.NaiveBayes(modelType=variant, labelCol="y"),
        "random_forest": lambda: C.RandomForestClassifier(numTrees=100, seed=seed, labelCol="y"),
    }
    model = Pipeline(stages=[kinds[name]()]).fit(indexer.transform(prepared[0]))
    out = model.transform(indexer.transform(prepared[1]))
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    p = vector_to_array(F.col(raw))
    if raw == "rawPrediction":
        top = F.array_max(p)
        e = F.transform(p, lambda x: F.exp(x - top))
        p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
    names = F.array(*[F.lit(c) for c in classes])
    proba = F.map_from_arrays(names, F.slice(p, 1, len(classes)))
    return out.select("image_id", F.col("label").alias("true_label"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_label"), proba.alias("proba"))

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions.vectors import l2_normalise
from wordloom.operators import classify, cluster, vocabulary


def points(spark, xs):
    return spark.createDataFrame([(f"i{k}", 0, [float(v) for v in x]) for k, x in enumerate(xs)], "image_id string, local_idx int, vec array<float>")


def test_blobs(spark):
    r = np.random.default_rng(0)
    xs = np.concatenate([r.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (-5, 5))])
    words = vocabulary.build_vocabulary(points(spark, xs), 3)
    assert words.count() == 3
    near = vocabulary.assign(points(spark, xs), words).groupBy("word_id").count().collect()
    assert sorted(r["count"] for r in near) == [20, 20, 20]


def test_too_few_vectors(spark):
    with pytest.raises(ValueError, match="n_candidates_per_class"):
        vocabulary.build_vocabulary(points(spark, np.zeros((2, 4))), 5)


def test_l2_normalise(spark):
    got = [r[0] for r in spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])], "k int, v array<double>").orderBy("k").select(l2_normalise(F.col("v"))).collect()]
    assert got == [pytest.approx([0.6, 0.8]), [0.0, 0.0], [1.0, 0.0]]


def test_cosine_words_are_directions(spark):
    r = np.random.default_rng(1)
    angles = np.concatenate([r.normal(a, 0.02, 30) for a in (0, math.pi / 2)])
    xs = np.stack([np.cos(angles), np.sin(angles)], axis=1) * r.uniform(1, 50, (60, 1))
    words = vocabulary.build_vocabulary(points(spark, xs), 2, metric="cosine")
    near = [x["word_id"] for x in vocabulary.assign(points(spark, xs), words, "cosine").orderBy(F.expr("int(substring(image_id, 2))")).collect()]
    assert len(set(near[:30])) == len(set(near[30:])) == 1
    assert near[0] != near[-1]


def test_assign_keeps_all_columns_and_agrees_with_plain_loops(spark, monkeypatch):
    r = np.random.default_rng(2)
    xs = np.concatenate([r.normal(size=(40, 6)), np.zeros((1, 6))])
    d = points(spark, xs).withColumn("note", F.concat(F.lit("n"), "image_id")).withColumn("word_id", F.lit("old"))
    d = d.unionByName(spark.createDataFrame([("none", 0, None, "nnone", "old")], d.schema))
    for n in (1, 9, 512, 513, 700):
        m = r.normal(size=(n, 6))
        m[n // 2] = m[0]  # a tie, which goes to the smaller id
        words = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(m)], "word_id int, center array<double>").repartition(3)
        for metric in ("euclidean", "cosine"):
            unit = lambda v: v / max(np.linalg.norm(v), 1e-300) if metric == "cosine" else v  # noqa: B023, E731
            want = {f"i{k}": min(range(n), key=lambda w: (round(float(((unit(np.float32(x).astype(float)) - unit(m[w])) ** 2).sum()), 9), w)) for k, x in enumerate(xs)}  # noqa: B023
            for limit in (1 << 20, 16 * 6 * 8):  # one pass, and blocks of words
                monkeypatch.setattr(vocabulary, "WORD_BYTES", limit if n < 100 else 1 << 20)
                got = vocabulary.assign(d, words, metric, "d2").collect()
                assert got[0].asDict().keys() == {"image_id", "local_idx", "vec", "note", "word_id", "d2"}
                assert {x["image_id"]: x["word_id"] for x in got} == want | {"none": None}
                assert all(x["note"] == "n" + x["image_id"] for x in got)
                assert {x["image_id"]: x["vec"] for x in got}["i3"] == [float(np.float32(v)) for v in xs[3]]


def test_a_seed_decides_the_vocabulary_however_rows_lie(spark):
    r = np.random.default_rng(8)
    d = points(spark, r.normal(size=(300, 4)))
    centres = [np.array([x["center"] for x in vocabulary.build_vocabulary(p, 7, batch=b).orderBy("word_id").collect()]) for b in (None, 100) for p in (d.coalesce(1), d.repartition(5))]
    assert centres[0] == pytest.approx(centres[1], abs=1e-9) and centres[2] == pytest.approx(centres[3], abs=1e-9)


def test_k_means_rests_where_plain_rounds_do(spark):
    r = np.random.default_rng(9)
    xs = np.concatenate([r.normal(c, 0.5, (50, 3)) for c in np.eye(3) * 6])
    c = np.array([x["center"] for x in vocabulary.build_vocabulary(points(spark, xs), 3).collect()])
    x = xs.astype(np.float32).astype(float)
    near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    assert np.stack([x[near == k].mean(axis=0) for k in range(3)]) == pytest.approx(c, abs=1e-2)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_knn_against_all_pairs(spark, monkeypatch, k):
    r = np.random.default_rng(10)
    train = [(i, "ab"[i % 2], [float(v) for v in r.integers(0, 3, 3)]) for i in range(40)]
    test = [(100 + i, "a", [float(v) for v in r.integers(0, 3, 3)]) for i in range(15)]
    monkeypatch.setattr(classify, "KNN_BYTES", 8 * 3 * 11)  # several blocks
    got = {x["image_id"]: x["predicted_label"] for x in classify.knn(*(spark.createDataFrame(t, "image_id long, label string, vec array<double>") for t in (train, test)), k).collect()}
    for i, _, v in test:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, u)), 9), j, lab) for j, lab, u in train)[:k]
        votes = [lab for *_, lab in near]
        assert got[i] == min(sorted(set(votes)), key=lambda lab: (-votes.count(lab), lab))


def test_density_clusters(spark):
    r = np.random.default_rng(3)
    xs = np.concatenate([r.normal(c, 0.05, (15, 2)) for c in ((0, 0), (3, 3), (-3, 3))] + [np.array([[20.0, 20.0]])])
    labels, prob = cluster.leaf_clusters(xs, 5)
    for k in range(3):
        own = labels[15 * k : 15 * k + 15]
        assert (own[own >= 0] == own[own >= 0][0]).all()
    assert len(set(labels[labels >= 0])) >= 3
    assert labels[-1] == -1
    assert ((prob >= 0) & (prob <= 1)).all()
    got = cluster.density_clusters(points(spark, xs), 5).collect()
    assert len(got) == 46


@pytest.mark.parametrize("min_samples", [1, 4])
def test_large_groups_give_the_same_clusters(spark, monkeypatch, min_samples):
    r = np.random.default_rng(5)
    xs = np.concatenate([r.normal(c, 0.1, (60, 5)) for c in np.eye(5)[:4] * 3] + [r.normal(0, 2, (10, 5))])
    d = points(spark, xs)
    want = sorted((x["image_id"], x["local_idx"], x["label"], round(x["prob"], 6)) for x in cluster.density_clusters(d, 5, min_samples).collect())
    assert len({x[2] for x in want}) > 3
    monkeypatch.setattr(cluster, "MOST_POINTS", 50)
    monkeypatch.setattr(cluster, "CHUNK_BYTES", 70 * 5 * 8)  # four chunks
    got = cluster.density_clusters(d, 5, min_samples)
    assert sorted((x["image_id"], x["local_idx"], x["label"], round(x["prob"], 6)) for x in got.collect()) == want
    ordered, n = cluster.numbered(d.select("image_id", "local_idx", F.col("vec").cast("array<double>").alias("vec")), "image_id", "local_idx")
    x = np.array([v["vec"] for v in ordered.orderBy("__i").collect()])
    assert np.sort(cluster.spanning_edges_of(ordered, n, min_samples)[:, 2]) == pytest.approx(np.sort(cluster.spanning_edges(x, min_samples)[:, 2]))


def test_large_umap_lays_out_every_point(spark, monkeypatch):
    """Rows outside the sample come to lie among their own kind."""
    r = np.random.default_rng(6)
    xs = np.concatenate([r.normal(c, 0.1, (60, 5)) for c in np.eye(5)[:3] * 4])
    monkeypatch.setattr(cluster, "MOST_POINTS", 60)
    got = {x["image_id"]: np.array(x["vec"]) for x in cluster.reduce(points(spark, xs).withColumn("note", F.lit("n")), "umap", 2, 8).collect()}
    assert len(got) == 180
    own = [np.array([got[f"i{k}"] for k in range(60 * c, 60 * c + 60)]) for c in range(3)]
    centres = [o.mean(axis=0) for o in own]
    right = [np.argmin([np.linalg.norm(v - c) for c in centres]) == k for k, o in enumerate(own) for v in o]
    assert np.mean(right) > 0.95


def test_lloyd_needs_points(spark):
    with pytest.raises(ValueError):
        vocabulary.lloyd(spark.createDataFrame([(1, [0.0])], "id int, vec array<double>"), 2, 1)


def test_umap_keeps_blobs_apart(spark):
    r = np.random.default_rng(4)
    xs = np.concatenate([r.normal(c, 0.1, (25, 5)) for c in (np.eye(5)[0] * 4, np.eye(5)[1] * 4, np.eye(5)[2] * 4)])
    y = cluster.umap(xs, 2, 8, epochs=100)
    assert (y == cluster.umap(xs, 2, 8, epochs=100)).all()
    own = [y[25 * k : 25 * k + 25] for k in range(3)]
    inside = max(np.linalg.norm(o - o.mean(axis=0), axis=1).mean() for o in own)
    apart = min(np.linalg.norm(own[a].mean(axis=0) - own[b].mean(axis=0)) for a in range(3) for b in range(a))
    assert apart > 2 * inside
    for method in ("none", "pca", "umap"):
        got = cluster.reduce(points(spark, xs), method, 2).collect()
        assert len(got) == 75
        assert np.linalg.norm(got[0]["vec"]) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        cluster.reduce(points(spark, xs), "none such")


@pytest.mark.parametrize("name", classify.CLASSIFIERS)
def test_every_classifier_tells_blobs_apart(spark, name):
    r = np.random.default_rng(12)
    rows = [(f"{c}{i}", c, [float(v) for v in r.normal(4 * k + 3, 0.3, 3).clip(0)]) for k, c in enumerate("ab") for i in range(30)]
    df = spark.createDataFrame(rows, "image_id string, label string, vec array<float>")
    side = F.substring("image_id", 2, 2).cast("int") < 20
    got = classify.classify(name, df.where(side), df.where(~side), boosting_rounds=3).collect()
    assert len(got) == 20
    assert sum(x["true_label"] == x["predicted_label"] for x in got) >= 18
    assert all(set(x["proba"]) == {"a", "b"} or name == "knn" for x in got)


def test_multinomial_needs_counts(spark):
    df = spark.createDataFrame([("1", "a", [-1.0, 2.0]), ("2", "b", [1.0, 2.0])], "image_id string, label string, vec array<float>")
    with pytest.raises(ValueError, match="gaussian"):
        classify.classify("naive_bayes", df, df, variant="multinomial")

import pytest
from pyspark.sql import functions as F

from wordloom.operators import candidates, selection, stats

ROWS = [("cat_1", 0, 0, 0.90), ("cat_1", 1, 0, 0.40), ("cat_1", 2, 1, 0.70), ("dog_1", 0, 2, 0.60), ("dog_1", 1, 2, 0.95)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "image_id string, local_idx int, cluster_id int, prob double").cache()


def chosen(spark, rows, n):
    labels = spark.createDataFrame([("cat_1", "cat"), ("dog_1", "dog")], "image_id string, class string")
    occ = stats.occurrence(rows.withColumnRenamed("cluster_id", "word_id"))
    dense = stats.densified(stats.class_word(occ, labels), stats.class_size(occ, labels))
    return selection.select_top_n(selection.scores(dense, ["GCF"]), n).withColumnRenamed("word_id", "cluster_id").cache()


def audit(df):
    return {r["cluster_id"]: (r["selection_count"], r["cluster_size"], r["n_taken"]) for r in df.collect()}


def test_legacy_pool_without_overlap(spark, rows):
    c = chosen(spark, rows, 1)
    assert audit(candidates.legacy_audit(c, rows)) == {0: (1, 2, 1), 2: (1, 2, 1)}
    assert {(r["image_id"], r["local_idx"]) for r in candidates.legacy_pool(c, rows).collect()} == {("cat_1", 0), ("dog_1", 1)}


def test_legacy_pool_pads_with_zero_scores(spark, rows):
    c = chosen(spark, rows, 2)
    assert {k: sorted(r["cluster_id"] for r in c.where(F.col("class") == k).collect()) for k in ("cat", "dog")} == {"cat": [0, 1], "dog": [0, 2]}
    assert audit(candidates.legacy_audit(c, rows)) == {0: (2, 2, 2), 1: (1, 1, 1), 2: (1, 2, 1)}
    assert candidates.legacy_pool(c, rows).count() == 4


def test_legacy_pool_takes_no_more_than_there_is(spark, rows):
    c = spark.createDataFrame([("cat", 1, 5.0), ("dog", 1, 5.0)], "class string, cluster_id int, score double")
    assert audit(candidates.legacy_audit(c, rows)) == {1: (2, 1, 1)}


def test_weighted_pool(spark, rows):
    c = chosen(spark, rows, 2)
    got = {(r["class"], r["cluster_id"]): (r["n_allocated"], r["n_duplicated"]) for r in candidates.weighted_allocation(c, rows, 10).collect()}
    assert got == {("cat", 0): (3, 1), ("cat", 1): (2, 1), ("dog", 0): (0, 0), ("dog", 2): (5, 3)}
    pool = candidates.weighted_pool(c, rows, 10)
    taken = {(r["image_id"], r["local_idx"]): r["count"] for r in pool.groupBy("image_id", "local_idx").count().collect()}
    assert taken == {("cat_1", 0): 2, ("cat_1", 1): 1, ("cat_1", 2): 2, ("dog_1", 1): 3, ("dog_1", 0): 2}
    vectors = spark.createDataFrame([(i, k, [float(k)] * 4) for i, k, _, _ in ROWS], "image_id string, local_idx int, vec array<float>")
    assert candidates.gather(pool, vectors).count() == 10

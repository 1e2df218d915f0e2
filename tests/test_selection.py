import math

import pytest
from pyspark.sql import functions as F

from wordloom.operators import selection, stats

CAT = [[2, 8, 1, 0], [2, 0, 1, 0], [2, 0, 1, 0], [2, 0, 1, 0]]
DOG = [[0, 2, 1, 3]] * 3


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"{c}_{i}", w, f) for c, imgs in (("cat", CAT), ("dog", DOG)) for i, img in enumerate(imgs) for w, f in enumerate(img) if f]
    occ = spark.createDataFrame(rows, "image_id string, word_id int, f bigint")
    labels = spark.createDataFrame([(f"{c}_{i}", c) for c, n in (("cat", 4), ("dog", 3)) for i in range(n)], "image_id string, class string")
    dense = stats.densified(stats.class_word(occ, labels), stats.class_size(occ, labels)).cache()
    return occ, labels, dense


def by_class(df, column="score"):
    out = {}
    for r in df.orderBy("class", "word_id").collect():
        out.setdefault(r["class"], []).append(r[column])
    return out


def test_counts(tables):
    occ, labels, dense = tables
    assert by_class(dense, "freq") == {"cat": [8, 8, 4, 0], "dog": [0, 6, 3, 9]}
    assert by_class(dense, "df") == {"cat": [4, 1, 4, 0], "dog": [0, 3, 3, 3]}
    assert by_class(stats.out_of_class(dense), "df_out")["cat"] == [0, 3, 3, 3]
    assert {r["word_id"]: r["n_classes"] for r in stats.classes_containing(stats.class_word(occ, labels)).collect()} == {0: 1, 1: 2, 2: 2, 3: 1}


def test_scores(tables):
    dense = tables[2]
    inter = -(4 / 7 * math.log2(4 / 7) + 3 / 7 * math.log2(3 / 7))
    d = 1 - inter
    assert by_class(selection.scores(dense, ["GCF"])) == {"cat": [8, 8, 4, 0], "dog": [0, 6, 3, 9]}
    assert by_class(selection.scores(dense, ["ICC"])) == {"cat": pytest.approx([8, 0, 4, 0]), "dog": pytest.approx([0, 6, 3, 9])}
    assert by_class(selection.scores(dense, ["CED"])) == {"cat": pytest.approx([8, 0, 4 * d, 0]), "dog": pytest.approx([0, 6 * d, 3 * d, 9])}


def test_words_of_one_image_or_class_are_exactly_zero(spark):
    rows = [("a1", 0, 3), ("a1", 1, 7), ("a2", 1, 5), ("b1", 2, 11), ("b2", 2, 3)]
    occ = spark.createDataFrame(rows, "image_id string, word_id int, f bigint")
    labels = spark.createDataFrame([(i, i[0]) for i in ("a1", "a2", "b1", "b2")], "image_id string, class string")
    dense = stats.densified(stats.class_word(occ, labels), stats.class_size(occ, labels))
    e = {(r["class"], r["word_id"]): r for r in selection.entropies(dense).collect()}
    assert e["a", 0]["h_intra"] == 0.0
    assert all(r["h_inter"] == 0.0 for r in e.values())
    assert all(r["score"] >= 0 for r in selection.scores(dense).collect())


def test_top_n_union_overlap(tables):
    dense = tables[2]
    top = selection.select_top_n(selection.scores(dense, ["GCF"]), 2)
    chosen = {c: {r["word_id"] for r in top.where(F.col("class") == c).collect()} for c in ("cat", "dog")}
    assert chosen == {"cat": {0, 1}, "dog": {1, 3}}
    assert {r["word_id"] for r in selection.union_vocabulary(top).collect()} == {0, 1, 3}
    assert [r["word_id"] for r in selection.overlap(top, "cat", "dog").collect()] == [1]
    for n in (None, 100):
        assert selection.select_top_n(selection.scores(dense, ["GCF"]), n).count() == 8
    assert [selection.top_n_for_vocabulary(*x) for x in ((100, 5), (47, 10), (2, 10))] == [20, 4, 1]


def test_unknown_and_registered_strategies(tables):
    with pytest.raises(ValueError):
        selection.scores(tables[2], ["none"])
    selection.register_strategy("DF")(lambda: F.col("df").cast("double"))
    try:
        assert by_class(selection.scores(tables[2], ["DF"]))["cat"] == [4, 1, 4, 0]
    finally:
        del selection.STRATEGIES["DF"]


def test_masks(spark):
    occ = spark.createDataFrame([("i", w, w + 1) for w in range(5)], "image_id string, word_id int, f bigint")
    chosen = spark.createDataFrame([(1,), (3,)], "word_id int")
    assert [r["f"] for r in stats.masked_zero(occ, chosen, occ).orderBy("word_id").collect()] == [0, 2, 0, 4, 0]
    assert [r["f"] for r in stats.masked_compact(occ, chosen).orderBy("dim").collect()] == [2, 4]


def test_noise_and_gaps(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([-1, 5, 9, 5, -1])], "id int, label int")
    assert {(r["id"], r["cluster_id"]) for r in stats.survivors(rows).collect()} == {(1, 0), (2, 1), (3, 0)}
    assert stats.noise_share(rows).first()["share"] == pytest.approx(0.4)

import pytest

from wordloom.operators import positional

ROWS = [("cat_1", 0, 0, 0.9), ("cat_2", 0, 0, 0.5), ("dog_1", 0, 1, 0.8), ("dog_2", 0, 1, 0.3), ("cat_1", 1, 2, 0.7), ("cat_2", 1, 3, 0.6), ("dog_1", 1, 2, 0.4)]
VECS = {("cat_1", 0): 1, ("cat_2", 0): 3, ("dog_1", 0): 5, ("dog_2", 0): 7, ("cat_1", 1): 2, ("cat_2", 1): 4, ("dog_1", 1): 6}


@pytest.fixture(scope="module")
def t(spark):
    rows = spark.createDataFrame(ROWS, "image_id string, position int, word_id int, prob double").cache()
    labels = spark.createDataFrame([(i, i[:3]) for i in ("cat_1", "cat_2", "dog_1", "dog_2")], "image_id string, class string").cache()
    words = positional.position_words(rows, labels, 2, ["GCF"]).cache()
    return rows, labels, words


def test_stats(t):
    got = {(r["position"], r["class"], r["word_id"]): r["freq"] for r in positional.positional_stats(t[0], t[1]).collect()}
    assert got == {(0, "cat", 0): 2, (0, "dog", 1): 2, (1, "cat", 2): 1, (1, "cat", 3): 1, (1, "dog", 2): 1}


def test_words(t):
    got = {}
    for r in t[2].orderBy("position", "class", "rank").collect():
        got.setdefault((r["position"], r["class"]), []).append(r["word_id"])
    assert got == {(0, "cat"): [0], (0, "dog"): [1], (1, "cat"): [2, 3], (1, "dog"): [2]}


def test_words_of_one_image_are_dropped_by_entropy(t):
    got = positional.position_words(t[0], t[1], 2, ["ICC"])
    assert not [r for r in got.collect() if r["position"] == 1 and r["class"] == "cat"]


def test_representatives_and_images(spark, t):
    rows, labels, words = t
    reps = positional.representatives(rows, words)
    assert {(r["position"], r["word_id"]): VECS[r["image_id"], r["position"]] for r in reps.collect()} == {(0, 0): 1, (0, 1): 5, (1, 2): 2, (1, 3): 4}
    classes, positions = labels.select("class").distinct(), spark.createDataFrame([(0,), (1,)], "position int")
    images = positional.synthetic(words, reps, classes, positions, 3)
    vec = spark.createDataFrame([(i, p, [float(v)] * 2) for (i, p), v in VECS.items()], "image_id string, local_idx int, vec array<float>")
    got = {}
    for r in positional.with_vectors(images, vec, 2).orderBy("j").collect():
        got.setdefault((r["class"], r["position"]), []).append(r["vec"][0])
    assert got == {("cat", 0): [1, 1, 1], ("cat", 1): [2, 4, 2], ("dog", 0): [5, 5, 5], ("dog", 1): [2, 2, 2]}


def test_no_word_is_a_zero_vector(spark, t):
    rows, labels, words = t
    fewer = words.where("not (position = 0 and class = 'cat')")
    classes, positions = labels.select("class").distinct(), spark.createDataFrame([(0,), (1,)], "position int")
    assert positional.empty_pairs(fewer, classes, positions).first()["n_empty"] == 1
    images = positional.synthetic(fewer, positional.representatives(rows, fewer), classes, positions, 2)
    vec = spark.createDataFrame([(i, p, [float(v)] * 2) for (i, p), v in VECS.items()], "image_id string, local_idx int, vec array<float>")
    zero = [r["vec"] for r in positional.with_vectors(images, vec, 2).collect() if r["class"] == "cat" and r["position"] == 0]
    assert zero == [[0.0, 0.0]] * 2
    assert positional.default_synthetic_count(7, 2) == 3
    assert positional.default_synthetic_count(1, 5) == 1

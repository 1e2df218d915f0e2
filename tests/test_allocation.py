import pytest

from wordloom.operators.allocation import allocate_counts, pick_cyclic


@pytest.mark.parametrize(
    ("scores", "total", "expected"),
    [([0.8, 0.7, 0.6, 0.5, 0.4], 250, [67, 58, 50, 42, 33]), ([1, 1, 1], 10, [4, 3, 3]), ([0, 0, 0, 0], 10, [3, 3, 2, 2]), ([], 0, []), ([0.8, 0.2], 0, [0, 0])],
)
def test_largest_remainder(spark, scores, total, expected):
    got = allocate_counts(spark, scores, total)
    assert got == expected
    assert sum(got) == total


@pytest.mark.parametrize(("scores", "total"), [([], 5), ([1], -1), ([1, -0.5], 10)])
def test_bad_totals_and_scores(spark, scores, total):
    with pytest.raises(ValueError):
        allocate_counts(spark, scores, total)


@pytest.mark.parametrize(("members", "n", "expected"), [("abc", 2, "ab"), ("ab", 5, "ababa"), ("ab", 2, "ab"), ("a", 0, "")])
def test_cyclic_pick(spark, members, n, expected):
    m = spark.createDataFrame([("k", i + 1, c) for i, c in enumerate(members)], "key string, member_rank int, m string")
    got = pick_cyclic(spark.createDataFrame([("k", n)], "key string, n bigint"), m, ["key"]).orderBy("slot").collect()
    assert "".join(r["m"] for r in got) == expected

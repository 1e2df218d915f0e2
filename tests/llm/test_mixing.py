import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordloom.llm import mixing


def brute_targets(sizes):
    """sizes: {source: words}; water filling, one round after another."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 3, "d": 0, None: 40}, {"a": 0}, {"x": 7}, {"é": 900, "z": 10, "Z": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want)
    for s, t in want.items():
        assert got[s] == pytest.approx(t)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("seed"))).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert got != list(range(n))


DOCS = [(i, " ".join(["w"] * (i * 7 % 900)), f"s{i % 4}") for i in range(120)] + [(200, None, "s0"), (201, "", None), (202, " \t\n", "s1"), (203, "w " * 20_000, "s2"), (204, "one", None), (0, "again and again", "s0"), (0, "again and again", "s0"), (None, "no id", "s3")]


def source_of(r):
    return r["source"] if "source" in r else None if r["__name"] == "null" else r["__name"][1:]


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, t, s in docs:
        by[s] += size(t)
    want = brute_targets(dict(by))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, t, _ in docs)
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == by[source_of(r)]
        assert r["target"] == pytest.approx(want[source_of(r)])
        taken[source_of(r)] += r["taken"]
    for s, t in want.items():
        assert taken[s] == round(t)


def test_takings(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, source string, size int")
    base = mixing.sized(docs)
    rows = mixing.takings(base).collect()
    check(rows, DOCS)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.takings(base).collect()))


def test_slots_against_takings(spark):
    """What slots take of blocks, added up in Python, is what documents report."""
    base = mixing.sized(spark.createDataFrame(DOCS, "doc_id long, text string, source string"))
    targets = mixing.source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    slots = mixing.slots_of(targets, shards=8).collect()
    places = [(r["shard"], r["position"]) for r in slots]
    assert len(set(places)) == len(places)
    pieces = mixing.pieces_of(base, base.count()).collect()
    got = Counter()
    for s in slots:
        for p in pieces:
            if p["block"] == s["block"] and p["__name"] == s["__name"]:
                got[p["__row"]] += max(0, min(p["hi"], s["words"]) - p["lo"])
    assert {r["__row"]: r["taken"] for r in mixing.takings(base).collect()} == {p["__row"]: got[p["__row"]] for p in pieces}
    again = Counter((s["__name"], s["block"]) for s in slots)
    assert max(again.values()) <= 3


def test_empty(spark):
    assert mixing.takings(mixing.sized(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0


def test_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = mixing.op8_source_mix(spark, small)
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken", "pieces", "first_shard", "first_position"]
    source = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, source string")
    check(rows.join(source, "doc_id").collect(), docs)


def test_dealt_slots_hold_what_is_taken(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)
    base = mixing.sized(docs)
    taken = {r["__row"]: r["taken"] for r in mixing.takings(base).collect()}
    rows = mixing.dealt(base, 8).collect()
    words, slots = Counter(), defaultdict(list)
    for r in rows:
        words[r["__row"]] += r["hi"] - r["lo"]
        slots[r["shard"], r["position"]].append((r["lo"], r["hi"]))
    assert words == Counter({k: v for k, v in taken.items() if v})
    assert {s for s, _ in slots} <= set(range(8)) and len({s for s, _ in slots}) > 1
    for spans in slots.values():  # a slot's documents lie end to end, without gaps
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= mixing.BLOCK


SLOTS = [("sa", 4000), ("sb", 2500), ("sc", 3), ("sd", 1), ("null", 1500), ("se", 0)]


def test_shard_counts_are_multinomial_and_sum_to_both_margins(spark):
    totals = spark.createDataFrame(SLOTS, "__name string, slots long")
    rows = mixing.shard_counts(totals, 40).collect()
    n = sum(v for _, v in SLOTS)
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        per_source[r["__name"]] += r["n"]
        per_shard[r["shard"]] += r["n"]
    assert per_source == Counter({k: v for k, v in SLOTS if v})
    size = -(-n // 40)
    assert [per_shard[k] for k in range(40)] == [size] * 39 + [n - 39 * size]
    # the spread over shards is that of a multinomial draw, not an even deal
    for name in ("sa", "sb", "null"):
        own = [next((r["n"] for r in rows if r["shard"] == k and r["__name"] == name), 0) for k in range(39)]
        p = dict(SLOTS)[name] / n
        mean, expected = sum(own) / 39, size * p * (1 - p)
        assert abs(mean - size * p) < 3 * (expected / 39) ** 0.5 + 1
        assert 0.4 * expected < sum((x - mean) ** 2 for x in own) / 38 < 2.2 * expected
    assert sorted(map(str, rows)) == sorted(map(str, mixing.shard_counts(totals, 40).collect()))


def test_slots_follow_the_counts(spark):
    targets = spark.createDataFrame([("a", 100 * mixing.BLOCK, 250.0 * mixing.BLOCK + 7), ("b", 40 * mixing.BLOCK + 9, 30.0 * mixing.BLOCK)], "source string, source_size long, target double")
    slots = mixing.slots_of(targets, 16).collect()
    counts = {(r["shard"], r["__name"]): r["n"] for r in mixing.shard_counts(mixing.slot_totals(targets), 16).collect()}
    assert Counter((s["shard"], s["__name"]) for s in slots) == Counter(counts)
    for k in {s["shard"] for s in slots}:
        assert sorted(s["position"] for s in slots if s["shard"] == k) == list(range(sum(v for (i, _), v in counts.items() if i == k)))
    for p in (0, 1):
        assert sorted(s["block"] for s in slots if s["__name"] == "sa" and s["pass"] == p) == list(range(100))


def test_packed_blocks_hold_the_words(spark):
    docs = [(i, " ".join(f"{i}_{k}" for k in range(i * 37 % 700)), f"s{i % 3}") for i in range(60)] + [(None, "x\ty\nz", "s0"), (70, None, "s1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.packed(df, 4).collect()
    words = [w for r in rows for w in r["text"].split(" ")]
    assert all(r["n_words"] == len(r["text"].split(" ")) <= mixing.BLOCK for r in rows)
    own = Counter(w.split("_")[0] for w in words)
    taken = {r["doc_id"]: r["taken"] for r in mixing.takings(mixing.sized(df), 4).collect()}
    assert {k: v for k, v in taken.items() if v and k is not None} == {int(k): v for k, v in own.items() if k not in "xyz"}
    for r in rows:  # a document's words stand in their order
        for i in r["doc_ids"]:
            at = [int(w.split("_")[1]) for w in r["text"].split(" ") if w.startswith(f"{i}_")]
            assert at == sorted(at)


def test_copies_come_near_the_targets(spark):
    docs = [(i, "w " * (1 + i * 131 % 900), f"s{i % 4}") for i in range(400)] + [(1000, "w " * 5000, "s9"), (1001, "w " * 4000, "s9")]
    base = mixing.sized(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    x = {r["__row"]: r for r in mixing.takings(base).collect()}
    copies = {r["__row"]: r["copies"] for r in mixing.copies_of(base).collect()}
    assert all(x[k]["taken"] // x[k]["size"] <= c <= -(-x[k]["taken"] // x[k]["size"]) for k, c in copies.items())
    for name in {r["__name"] for r in x.values()}:
        own = [r for r in x.values() if r["__name"] == name]
        assert abs(sum(copies[r["__row"]] * r["size"] for r in own) - own[0]["target"]) <= 1.2 * max(r["size"] for r in own)


def test_many_rows_without_an_id_lie_in_many_buckets(spark):
    df = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 97).alias("size"))
    assert df.select(mixing._buckets(400)).distinct().count() == 16


def test_extra_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*d, 1, 2, "x") for d in DOCS], "doc_id long, text string, source string, __row int, n int, block string")
    check(mixing.takings(mixing.sized(docs)).collect(), DOCS)

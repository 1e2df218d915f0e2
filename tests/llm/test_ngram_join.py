import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import ngram_join as nj
from wordloom.llm.components import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    sets = [(i, shingles(t, n)) for i, t in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(docs, label):
        least[v] = min(least.get(v, i), i)
    return sorted((i, len(s), least[v]) for (i, s), v in zip(sets, label))


def corpus(seed, families=12):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    docs = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.choice([3, 6, 9, 20, 80, 300, 900]))]
        if r.random() < 0.4:
            base += passage
        docs.append(base)
        for _ in range(r.randrange(6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                k = r.randrange(len(copy))
                copy[k : k + 1] = r.choice([[], [r.choice(words)], [copy[k], r.choice(words)]])
            docs.append(copy)
    r.shuffle(docs)
    return [(i * 3 + 1, (" " if i % 2 else "\n").join(d).upper() if i % 5 == 0 else " ".join(d)) for i, d in enumerate(docs)]


EDGE = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two"), (9005, "ONE two"), (9006, "one"), (9007, "x " * 30_000), (9008, "x " * 30_000), (9009, "É é ab cd"), (9010, "é é ab cd")]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80)])
def test_against_all_pairs(spark, seed, n, percent):
    docs = corpus(seed) + EDGE
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_shingles int").repartition(3)
    assert sorted(tuple(r) for r in nj.jaccard_components(df, n, percent).collect()) == brute(docs, n, percent)


def test_repeated_rows_and_ids(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "a b c d e f")]
    got = sorted(tuple(r) for r in nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1)]


def test_large_regions_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(nj, "LEAVES", 8)
    r = random.Random(5)
    base = [f"w{r.randrange(300)}" for _ in range(200)]
    docs = []
    for i in range(60):  # two halves, each near its own first text, and some links only through others
        own = base if i % 2 else base[:100] + [f"v{k}" for k in range(100)]
        copy = list(own)
        for _ in range(i % 9):
            copy[r.randrange(200)] = f"z{r.randrange(50)}"
        docs.append((i, " ".join(copy)))
    got = sorted(tuple(x) for x in nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 60).collect())
    assert got == brute(docs, 4, 60)


def test_empty_and_lone(spark):
    assert nj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in nj.jaccard_components(spark.createDataFrame([(5, "a b c d e")], "doc_id long, text string")).collect()] == [(5, 2, 5)]


def test_signatures_of_linked_sets_meet():
    r = np.random.default_rng(0)
    for percent in (80, 85):
        for _ in range(1500):
            n = int(r.integers(4, 400))
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            drop, add = (int(r.integers(0, max(1, n // 8) + 1)) for _ in range(2))
            b = np.unique(np.concatenate((r.permutation(a)[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if 0 < common < len(a) + len(b) - common and 100 * common >= percent * (len(a) + len(b) - common):
                assert len(np.intersect1d(nj.signatures(a, percent), nj.signatures(b, percent)))


def test_tree_finds_all_links():
    r = np.random.default_rng(1)
    for _ in range(5):
        seeds = [np.unique(r.integers(0, 1 << 63, int(r.integers(3, 300)), dtype=np.uint64)) for _ in range(25)]
        sets = [s for s in seeds] + [np.unique(np.concatenate((s[int(r.integers(0, max(1, len(s) // 6))) :], r.integers(0, 1 << 63, 2, dtype=np.uint64)))) for s in seeds for _ in range(4)]
        order = nj.order_of(sets)
        sets = [sets[k] for k in order]
        tree = nj.Tree(sets, 80)
        links = list(tree.join())
        label = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                c = len(np.intersect1d(sets[a], sets[b]))
                if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    old, new = label[a], label[b]
                    label = [new if v == old else v for v in label]
        assert len(links) == len(sets) - len(set(label))
        assert len({(x, y) for x, y in zip(label, tree.label)}) == len(set(label))


def test_components(spark):
    r = random.Random(0)
    chain = [(k, k + 1) for k in range(0, 60)] + [(1000 + k, 1000) for k in range(1, 40)] + [(r.randrange(2000, 2050), r.randrange(2000, 2050)) for _ in range(40)]
    r.shuffle(chain)
    label = {x: x for e in chain for x in e}
    for _ in range(len(label)):
        for a, b in chain:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert got == {x: c for x, c in label.items() if x != c}


def test_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in nj.op9_signature_tree_join(spark, small).collect()) == brute(docs, 4, 85)


def footer_corpus(n, seed=7):
    """Short texts that link with nothing and end in the same six words."""
    r = random.Random(seed)
    return [(i, " ".join(f"w{r.randrange(100_000)}" for _ in range(r.randrange(6, 14))) + " all rights reserved by the author") for i in range(n)]


def largest_region(spark, docs):
    seen = nj.described(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 4, 85)
    sizes = nj._regions(nj.rarest(seen), len(docs)).groupBy("region").count().agg(F.max("count")).first()[0]
    return sizes or 0


def test_a_common_footer_brings_nothing_together(spark):
    assert max(largest_region(spark, footer_corpus(n)) for n in (2_000, 20_000)) <= 3


def test_common_passages_with_copies(spark):
    docs = footer_corpus(300)
    docs += [(1000 + i, t.replace("w1", "x1")) for i, t in docs[:40]] + [(2000 + i, t) for i, t in docs[:20]]
    got = sorted(tuple(r) for r in nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4, 60).collect())
    assert got == brute(docs, 4, 60)


def test_strays_of_several_groups_in_a_large_region(spark, monkeypatch):
    """Groups that share passages but don't link, each over LEAVES sets, some linked only through a chain of changes."""
    monkeypatch.setattr(nj, "LEAVES", 6)
    r = random.Random(11)
    common = [f"c{k}" for k in range(120)]
    docs = []
    for g in range(4):
        text = common[: 60 + 10 * g] + [f"g{g}_{k}" for k in range(60)]
        for i in range(15):
            if i % 3 == 0:
                text = list(text)
                text[r.randrange(len(text))] = f"n{g}_{i}"
            docs.append((g * 100 + i, " ".join([*text, f"own{i % 5}"])))
    r.shuffle(docs)
    for percent in (60, 75):
        got = sorted(tuple(x) for x in nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4, percent).collect())
        assert got == brute(docs, 4, percent)

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import ann


def brute(rows, queries, k=5):
    """By id: the k best (id, score), ties to the smaller id."""
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            known.setdefault(i, []).append(np.array(v, np.float64))
    out = {}
    for q in queries:
        for a in known.get(q, []):
            best = {}
            for i, vs in known.items():
                for b in vs:
                    if i != q and len(a) == len(b):
                        s = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
                        best[i] = max(best.get(i, -9), s)
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def run(spark, rows, queries, k=5):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "id long, vector array<float>, score string").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where(F.col("id").isin(list(queries))), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def same(got, want):
    want = {q: w for q, w in want.items() if w}
    assert set(got) == set(want)
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in w], abs=1e-12)


def f32(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def test_cases(spark):
    r = np.random.default_rng(0)
    rows = [(i, f32(r.normal(size=6))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(200, [0.0] * 6), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, []), (None, f32(r.normal(size=6)))]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 4.0]), (302, [1.0, 0.0]), (400, [1.0, 2.0, 3.0]), rows[5], rows[5], (3, rows[3][1])]
    queries = {0, 3, 5, 100, 119, 200, 201, 300, 400}
    got = run(spark, rows, queries)
    same(got, brute(rows, queries))
    assert [i for i, _ in got[119]] == [3, 100, 101, 102, 103]


def test_empty_tables(spark):
    assert run(spark, [], {0}) == {}
    assert run(spark, [(0, [1.0, 1.0])], {0}) == {}


def test_recall_with_many_lists(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 16))
    rows = [(i, f32(centres[i % 60] + 0.5 * r.normal(size=16))) for i in range(9000)]
    rows += [(20_000 + i, f32(centres[0] + 0.001 * r.normal(size=16))) for i in range(1500)]  # a hot neighbourhood
    monkeypatch.setattr(ann, "LIST_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_ROWS", 5)
    queries = set(range(0, 9000, 300)) | {20_000, 20_700}
    got, want = run(spark, rows, queries), brute(rows, queries)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries)
    assert hits >= 0.9 * 5 * len(queries)
    assert all(len(got[q]) == 5 for q in queries)


def test_queries_of_tiny_lists_get_k_answers(spark, monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(ann, "LIST_SHARE", 2)  # lists of about four entries
    rows = [(4 * g + i, f32(c + 0.001 * r.normal(size=12))) for g, c in enumerate(r.normal(size=(40, 12))) for i in range(4)]
    queries = set(range(0, 160, 7))
    got = run(spark, rows, queries)
    assert {q: len(a) for q, a in got.items()} == dict.fromkeys(queries, 5)
    assert all(len({i for i, _ in a}) == 5 and q not in {i for i, _ in a} for q, a in got.items())


@pytest.mark.parametrize("seed", [5, 7])
def test_a_few_vectors_opposite_a_blob_get_k_answers(spark, seed):
    r = np.random.default_rng(seed)
    axis = r.normal(size=16)
    rows = [(i, f32(axis + 0.3 * r.normal(size=16))) for i in range(396)] + [(1000 + i, f32(-axis + 0.01 * r.normal(size=16))) for i in range(4)]
    queries = {1000, 1001, 1002, 1003, 0, 50}
    got, want = run(spark, rows, queries), brute(rows, queries)
    assert {q: len(a) for q, a in got.items()} == dict.fromkeys(queries, 5)
    for q in (1000, 1001, 1002, 1003):
        assert {i for i, _ in got[q][:3]} == {i for i, _ in want[q][:3]}


def test_graph_search_finds_the_nearest_lists():
    r = np.random.default_rng(2)
    x = r.normal(size=(9000, 12)).astype(np.float32)
    index = ann.Index(x, len(x))
    assert len(index.centroids) == 90 and index.probes >= 64
    assert index.share.max() < 12 * index.share.mean()
    q = x[:200]
    found = index.search(q)
    sims = ann.unit(q) @ index.centroids.T
    hit = np.mean([len(set(f.tolist()) & set(np.argsort(-s)[: len(f)].tolist())) / len(f) for f, s in zip(found, sims)])
    assert hit > 0.95


def read(index, x, queries):
    """The share of all vectors that the queries read, and that of their 5 nearest among them."""
    homes, seen, hits = index.homes(x), [], 0
    u = ann.unit(x)
    for q, lists in zip(queries, index.search(x[queries])):
        mark = np.zeros(len(index.centroids), bool)
        mark[lists] = True
        found = np.array([mark[h].any() for h in homes])
        sims = u @ u[q]
        sims[q] = -9
        seen.append(found.mean())
        hits += found[np.argsort(-sims)[:5]].sum()
    return np.mean(seen), hits / (5 * len(queries))


def test_how_much_is_read_goes_by_how_the_vectors_lie(monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(ann, "LEAST_PROBES", 4)
    centres = r.normal(size=(300, 24))
    clustered = (centres[r.integers(0, 300, 12_000)] + 0.2 * r.normal(size=(12_000, 24))).astype(np.float32)
    alike = r.normal(size=(12_000, 24)).astype(np.float32)
    queries = np.arange(0, 12_000, 200)
    share, recall = read(ann.Index(clustered, 12_000), clustered, queries)
    assert share < 0.1 and recall > 0.9
    more, recall = read(ann.Index(alike, 12_000), alike, queries)
    assert more > 2 * share and recall > 0.9
    part = ann.Index(alike[::3], 12_000)  # fitted on a sample: its neighbours lie further apart
    assert read(part, alike, queries)[1] > 0.9


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {}
    for r in ann.op10_balanced_lists(spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    same(got, brute(rows, [i for i, _ in rows if i % 50 == 0]))

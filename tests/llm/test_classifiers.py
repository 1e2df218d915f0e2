import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import quality, toxicity

WORDS = [f"{a}{b}" for a in "ban kor lut mis nov per sul tra vek zon".split() for b in "a e in or um ti".split()]
BAD = ["vorpal", "grimble", "snarkle"]


def toxic_corpus(n=260, seed=0):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randrange(5, 300))]
        bad = i % 3 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(BAD)
        docs.append((i, " ".join(w), "xx", "s"))
        labels.append((i, int(not bad), int(bad)))
    return docs, labels


def poor_corpus(n=260, seed=0):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randrange(60, 400))]
        bad = i % 4 == 0
        if bad:
            k = r.randrange(len(w) - 40)
            w[k : k + 40] = [x.upper() + "!!" for x in w[k : k + 40]] if i % 8 else [w[k]] * 40
        docs.append((i, " ".join(w), "xx", "s"))
        labels.append((i, int(not bad), 0))
    return docs, labels


CASES = [(9000, None, None, None), (9001, "", None, None), (9002, " \n", None, None), (9003, "ban kor " * 60_000, None, None), (0, "ban kor", None, None), (None, "lut mis", None, None)]


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*x, 0.5) for x in docs], "doc_id long, text string, lang string, source string, score double").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("op", "corpus", "column", "cut"), [(toxicity, toxic_corpus, 2, 0.5), (quality, poor_corpus, 1, 0.3)])
def test_learns_and_handles_every_text(spark, op, corpus, column, cut):
    docs, labels = corpus()
    d, known = frames(spark, docs + CASES, labels)
    model = op.fit(d, known, 150)
    rows = op.score_column(d, model).collect()
    assert len(rows) == len(docs) + len(CASES)
    assert all(0 <= r["score"] <= 1 for r in rows)
    fresh_docs, fresh_labels = corpus(120, 9)
    got = {r["doc_id"]: r["score"] for r in op.score_column(frames(spark, fresh_docs, fresh_labels)[0], model).collect()}
    right = np.mean([(got[x[0]] >= cut) == bool(x[column]) for x in fresh_labels])
    assert right > 0.9
    kept = op.with_scores(d, model, name="score")
    assert sorted(kept.columns) == sorted(d.columns)
    assert {r["doc_id"]: r["score"] for r in rows if r["doc_id"] and r["doc_id"] > 0} == pytest.approx({r["doc_id"]: r["score"] for r in kept.collect() if r["doc_id"] and r["doc_id"] > 0})


def test_score_reads_nothing_but_the_text(spark):
    docs, labels = toxic_corpus()
    d, known = frames(spark, docs, labels)
    model = toxicity.fit(d, known, 150)
    a = [(1, docs[3][1], "de", "a"), (2, docs[3][1], "fr", "b")]
    got = [r["score"] for r in toxicity.score_column(frames(spark, a, labels)[0], model).collect()]
    assert got[0] == got[1]


def test_held_out_labels_teach_nothing(spark):
    docs, labels = toxic_corpus()
    d, known = frames(spark, docs, labels)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = known.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.score_column(d, toxicity.fit(d, k, 150)).orderBy("doc_id").collect() for k in (known, turned))
    assert one == two


@pytest.mark.parametrize(("op", "score"), [(toxicity, 0.0), (quality, 1.0)])
def test_without_labels_or_rows(spark, op, score):
    docs, labels = toxic_corpus(10)
    d, known = frames(spark, docs, labels)
    model = op.fit(d, known.limit(0))
    assert {r["score"] for r in op.score_column(d, model).collect()} == {score}
    assert op.score_column(d.limit(0), model).count() == 0
    nulls = known.select(F.lit(None).cast("long").alias("doc_id"), "quality", F.lit(None).cast("int").alias("toxic"))
    assert not op.fit(d.limit(0), nulls).fitted


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    docs, labels = toxic_corpus()
    model = toxicity.Classifier().fit([(1 + i % 4, t, x[1]) for (i, _, t), x in zip(labels, docs)])
    texts = [x[1] for x in docs] + [None, "", "ban " * 5000]
    whole = model.score(texts, model.words())
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    assert model.score(texts, model.words()) == pytest.approx(whole, abs=1e-6)
    assert np.concatenate([model.score([t], model.words()) for t in texts]) == pytest.approx(whole, abs=1e-6)


def test_pooling_against_plain_loops():
    docs, labels = toxic_corpus(60)
    model = toxicity.Classifier().fit([(1 + i % 4, t, x[1]) for (i, _, t), x in zip(labels, docs)])
    for x in docs[:10]:
        e = model.rows(toxicity.words_of(x[1]))[:, : toxicity.DIM]
        e = np.concatenate((e, np.zeros((2, toxicity.DIM), np.float32)))
        pooled = []
        for k in toxicity.WIDTHS:
            pooled.append(np.max([sum(e[t + j] @ model.w[k][j] for j in range(k)) for t in range(len(e) - 2)], axis=0))
        z = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.base[0]
        assert model.logits([x[1]], model.words())[0][0] == pytest.approx(z, abs=1e-4)


def test_attention_is_a_distribution_and_finds_the_poor_passage():
    docs, labels = poor_corpus(400)
    model = quality.Scorer().fit([(1, q, x[1]) for (_, q, _), x in zip(labels, docs)])
    table = quality.word_table()
    _, weights, counts = model.attend([x[1] for x in docs], table)
    starts = np.cumsum(counts) - counts
    assert np.add.reduceat(weights, starts) == pytest.approx(1.0, abs=1e-4)


@pytest.mark.parametrize(("op", "query", "column"), [(toxicity, "op2_toxicity", "toxic"), (quality, "op5_quality", "quality")])
def test_queries(spark, op, query, column):
    folder = "/root/testdata/sf0.01"
    got = getattr(op, query)(spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r["held_out"] and r[column] is not None]
    assert np.mean([r["predicted"] == r[column] for r in judged]) > 0.9


class Recorder:
    """Stands in for the optimiser: keeps the gradients and moves nothing."""

    def __init__(self):
        self.grads, self.rate, self.n = {}, 0.0, 1

    def step(self, grads):
        self.grads = {k: np.array(v, np.float64) for k, v in grads.items()}


def slope(loss, array, at, by=1e-2):
    old = array[at].copy()
    array[at] = old + by
    up = loss()
    array[at] = old - by
    down = loss()
    array[at] = old
    return (up - down) / (2 * by)


def logistic(z, y):
    return float(np.log1p(np.exp(-abs(z))) + max(z, 0) - z * y)


def test_attention_against_loops_and_its_gradients():
    docs, labels = poor_corpus(6, 4)
    model, words = quality.Scorer(), quality.word_table()
    r = np.random.default_rng(0)
    made = [quality.bags([d[1]], words)[:3] for d in docs]
    y, weight = np.array([v for _, v, _ in labels], np.float32), r.uniform(0.5, 2, 6).astype(np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    p = model.p

    def plain(d):
        h = np.maximum(model.encode(*made[d]) @ p["w1"] + p["b1"], 0)
        e = [sum(p["w"][g] * np.tanh(row @ p["v"][:, g]) / (1 + np.exp(-(row @ p["u"][:, g]))) for g in range(len(p["w"]))) for row in h]
        a = np.exp(np.array(e) - max(e))
        return float((a / a.sum()) @ h @ p["out"] + p["base"][0]), a / a.sum()

    counts = np.array([len(m[0]) for m in made])
    f = model.forward(model.encode(*(np.concatenate([m[k] for m in made]) for k in range(3))), counts)
    assert f["z"] == pytest.approx([plain(d)[0] for d in range(6)], abs=1e-4)
    assert f["weights"] == pytest.approx(np.concatenate([plain(d)[1] for d in range(6)]), abs=1e-5)

    seen, shapes = Recorder(), model.shapes.copy()
    model._step(np.arange(6), made, y, weight, seen, np.zeros((len(model.shapes), 1), np.float32))
    model.shapes = shapes  # the embeddings move by a rule of their own
    decayed = lambda: sum(0.5e-4 * float((p[k] ** 2).sum()) for k in ("w1", "out"))
    loss = lambda: sum(logistic(plain(d)[0], float(y[d])) * float(weight[d]) for d in range(6)) / 6 + decayed()
    for name, g in seen.grads.items():
        strongest = np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape)
        for at in zip(*strongest):
            assert slope(loss, p[name], at, 1e-4) == pytest.approx(g[at], rel=0.03, abs=1e-5), name


def test_convolution_against_loops_and_its_gradients():
    model = toxicity.Classifier()
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(WORDS, 9)) for _ in range(4)] + ["ban"]
    known = {w: k for k, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    ids = [np.array([known[w] for w in t.split()]) for t in texts]
    hashes, pad = toxicity._hashes(list(known)), max(toxicity.WIDTHS) - 1
    y, weight = np.array([1, 0, 1, 0, 1], np.float32), r.uniform(0.5, 2, 5).astype(np.float32)
    a, b, c = model.a.copy(), model.b.copy(), model.c.copy()

    def plain(d):
        x = np.array([a[h[0]] + b[h[1]] + c[h[2]] for h in hashes[ids[d]]] + [np.zeros(toxicity.DIM)] * pad, np.float64)
        z, at = model.base[0], 0
        for k in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = max(sum(x[i + j] @ model.w[k][j][:, f].astype(np.float64) for j in range(k)) + model.bias[at] for i in range(len(x) - pad))
                z += max(best, 0) * model.out[at]
                at += 1
        return float(z)

    got, _ = model.logits(texts, model.words())
    assert got == pytest.approx([plain(d) for d in range(5)], abs=1e-4)

    class Everything:
        def random(self, n):
            return np.ones(n)

    dense = {f"w{k}": model.w[k] for k in toxicity.WIDTHS} | {"bias": model.bias, "out": model.out, "base": model.base}
    moments = {k: np.zeros(len(v), np.float32) for k, v in (("a", a), ("b", b), ("c", c))}
    seen = Recorder()
    model._step(np.arange(5), ids, hashes, np.ones((len(known), 1), np.float32), y, weight, seen, dense, moments, pad, Everything())
    loss = lambda: sum(logistic(plain(d), float(y[d])) * float(weight[d]) for d in range(5)) / 5
    for name, g in seen.grads.items():
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:2], g.shape)):
            assert slope(loss, dense[name], at, 1e-3) == pytest.approx(g[at], rel=0.05, abs=1e-4), name


def labelled(n, seed=0):
    """(bucket, label, text) as toxicity's groups take them, and the frames they come from."""
    import zlib

    docs, labels = toxic_corpus(n, seed)
    return docs, labels, [(b, t, x[1]) for x, (i, _, t) in zip(docs, labels) if (b := zlib.crc32(str(i).encode()) % 5)]


def test_every_labelled_row_teaches_and_calibrates(spark, monkeypatch):
    """However small the groups are, each labelled row that isn't held out lies in one of them, once."""
    docs, labels, sample = labelled(260)
    d, known = frames(spark, docs + docs[:20] + [(5, "zzz later text", None, None)], labels + labels[:9])
    met = []
    monkeypatch.setattr(toxicity.Classifier, "learn", lambda self, groups, **how: met.append((groups.totals(), groups.tally(lambda g: g.spread(True)), groups.stored.count())))
    toxicity.fit(d, known, 20)
    whole = toxicity.Group.of(0, sample)
    (totals, spread, groups), = met
    assert groups > 4
    assert totals.tolist() == whole.totals().tolist() and totals.sum() == len(sample)
    assert spread.tolist() == whole.spread(True).tolist()


def test_groups_learn_like_one_and_however_they_lie(spark):
    docs, labels, sample = labelled(700)
    d, known = frames(spark, docs, labels)
    fresh, marks = toxic_corpus(150, 9)
    texts = [x[1] for x in fresh]
    here = toxicity.Classifier().fit(sorted(sample, key=lambda s: next(x[0] for x in docs if x[1] == s[2])))
    one = toxicity.fit(d, known)
    assert one.score(texts, one.words()) == pytest.approx(here.score(texts, here.words()), abs=1e-3)
    several, again = toxicity.fit(d, known, 130), toxicity.fit(d.repartition(7), known.repartition(2), 130)
    assert several.thresholds == again.thresholds
    got = several.score(texts, several.words())
    assert np.array_equal(got, again.score(texts, again.words()))
    assert np.mean([(s >= 0.5) == bool(m[2]) for s, m in zip(got, marks)]) > 0.9


def test_thresholds_of_groups_are_those_of_all_rows(spark):
    docs, labels, sample = labelled(400)
    model = toxicity.Classifier().fit(sample)
    from wordloom.llm.common import labelled_rows

    d, known = frames(spark, docs, labels)
    dealt = toxicity.Dealt(labelled_rows(d, known, "toxic"), 5)
    for aside in (True, False):
        assert dealt.thresholds(model, aside) == pytest.approx(toxicity.Here(toxicity.Group.of(0, sample)).thresholds(model, aside), abs=1e-4)

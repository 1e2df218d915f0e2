"""Quality by attention-based multiple-instance learning: a document is a bag of passages, every passage is
encoded, gated attention weights are learnt from document labels alone, and the weighted passage
representation is scored (Ilse, Tomczak, Welling 2018).

A passage is a run of 48 words. What its encoder reads: the mean of hashed embeddings of the words' shapes
(letters, case, digits and signs with runs shortened) and of their endings, and measures of case, signs,
digits, word length, repetition and line breaks. A passage is encoded by a rectified layer, weighed by
softmax(w . (tanh(V h) * sigmoid(U h))), and a document scored by a logistic layer on the weighted sum.

Cases: null and empty texts are one passage without words; without labels of both kinds every score is 1, so
that nothing is rejected on no evidence; repeated rows score alike; an empty table gives no rows. Texts are
read whole; neither lang, source nor ids are inputs.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Adam, Words, append_column, bucket_of, labelled_sample, map_rows, release, sigmoid, worker_state
from wordloom.session import table

PASSAGE, SHAPES, DIM, HIDDEN, GATE = 48, 1 << 12, 8, 16, 8
MEASURES = 8
_CLASSES = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([a-zß-öø-ÿ]+)|(\d+)")


def shape(word: str) -> str:
    """Upper case A, lower case a, digits 0, other characters themselves; runs count once."""
    short = _CLASSES.sub(lambda m: "A" if m[1] else "a" if m[2] else "0", word)
    return "".join(c for c, _ in itertools.groupby(short))[:12]


def _word_rows(words: list[str]) -> np.ndarray:
    """shape's bucket, ending's bucket, share of upper case, of signs, of digits, length, without letters or digits."""
    out = np.empty((len(words), 7), np.float32)
    for k, w in enumerate(words):
        n = len(w)
        letters, upper = sum(map(str.isalpha, w)), sum(map(str.isupper, w))
        digits = sum(map(str.isdigit, w))
        signs = n - letters - digits
        out[k] = (
            zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) & (SHAPES - 1),
            zlib.crc32(b"$" + w[-2:].encode("utf-8", "surrogatepass")) & (SHAPES - 1),
            upper / n if n > 1 else 0.0, signs / n, digits / n, min(n, 40) / 10.0, float(letters + digits == 0),
        )
    return out


def word_table() -> Words:
    return Words(_word_rows, 7)


def bags(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all passages of the texts: shape buckets and ending buckets (passages x PASSAGE, -1 where the passage is
    shorter), measures (passages x MEASURES), and passages per text."""
    slots = words.look_up([t.split() if t else [] for t in texts])
    counts = np.array([max(1, -(-len(s) // PASSAGE)) for s in slots])
    grid = np.zeros((int(counts.sum()), PASSAGE), np.int32)
    flat, at = grid.reshape(-1), 0
    for s, n in zip(slots, counts):
        flat[at * PASSAGE : at * PASSAGE + len(s)] = s
        at += n
    there = grid > 0
    size = np.maximum(1, there.sum(axis=1)).astype(np.float32)
    rows = words.rows
    ordered = np.sort(grid, axis=1)
    fresh = ((ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] > 0)).sum(axis=1) + (ordered[:, 0] > 0)
    twice = ((grid[:, 1:] == grid[:, :-1]) & there[:, 1:]).sum(axis=1)
    measures = np.empty((len(grid), MEASURES), np.float32)
    for k in range(5):
        measures[:, k] = rows[:, 2 + k][grid].sum(axis=1) / size
    measures[:, 5] = fresh / size
    measures[:, 6] = twice / size
    measures[:, 7] = size / PASSAGE
    a, b = rows[:, 0].astype(np.int32)[grid], rows[:, 1].astype(np.int32)[grid]
    a[~there] = b[~there] = -1
    return a, b, measures, counts


class Scorer:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = DIM + MEASURES
        self.shapes = (0.1 * r.standard_normal((SHAPES + 1, DIM))).astype(np.float32)
        self.shapes[-1] = 0  # the place of words that aren't there
        self.p = {
            "w1": (r.standard_normal((n, HIDDEN)) / np.sqrt(n)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32),
            "v": (0.3 * r.standard_normal((HIDDEN, GATE))).astype(np.float32), "u": (0.3 * r.standard_normal((HIDDEN, GATE))).astype(np.float32),
            "w": (0.3 * r.standard_normal(GATE)).astype(np.float32), "out": (0.3 * r.standard_normal(HIDDEN)).astype(np.float32), "base": np.zeros(1, np.float32),
        }
        self.mean, self.spread = np.zeros(MEASURES, np.float32), np.ones(MEASURES, np.float32)
        self.fitted, self.stamp = False, ""

    def encode(self, a: np.ndarray, b: np.ndarray, measures: np.ndarray) -> np.ndarray:
        """What the rectified layer reads of each passage."""
        out = np.empty((len(a), DIM + MEASURES), np.float32)
        for k in range(0, len(a), 4096):
            size = np.maximum(1, (a[k : k + 4096] >= 0).sum(axis=1, keepdims=True))
            out[k : k + 4096, :DIM] = (self.shapes[a[k : k + 4096]].sum(axis=1) + self.shapes[b[k : k + 4096]].sum(axis=1)) / size
        out[:, DIM:] = (measures - self.mean) / self.spread
        return out

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.p
        pre = x @ p["w1"] + p["b1"]
        h = np.maximum(pre, 0)
        tv, su = np.tanh(h @ p["v"]), sigmoid(h @ p["u"]).astype(np.float32)
        e = (tv * su) @ p["w"]
        starts = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        weights = e / np.add.reduceat(e, starts)[doc]
        bag = np.add.reduceat(h * weights[:, None], starts, axis=0)
        return {"pre": pre, "h": h, "tv": tv, "su": su, "weights": weights, "bag": bag, "doc": doc, "starts": starts, "z": bag @ p["out"] + p["base"][0]}

    def attend(self, texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, the attention of all passages, and passages per text."""
        a, b, m, counts = bags(texts, words)
        if not self.fitted:
            return np.ones(len(texts)), np.repeat(1.0 / counts, counts), counts
        f = self.forward(self.encode(a, b, m), counts)
        return sigmoid(f["z"].astype(np.float64)), f["weights"], counts

    def fit(self, sample: list[tuple[int, int, str]], epochs: int = 6, batch: int = 32, rate: float = 0.005, seed: int = 3) -> Scorer:
        y = np.array([v for _, v, _ in sample], np.float32)
        if len(set(y.tolist())) < 2:
            return self
        words, made = word_table(), []
        for _, _, t in sample:
            made.append(bags([t], words)[:3])
        every = np.concatenate([m for _, _, m in made])
        self.mean, self.spread = every.mean(axis=0), every.std(axis=0) + 1e-3
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        adam, r = Adam(self.p, rate), np.random.default_rng(seed)
        moments = np.zeros((SHAPES + 1, 1), np.float32)
        for _ in range(epochs):
            order = r.permutation(len(sample))
            for at in range(0, len(order), batch):
                self._step(order[at : at + batch], made, y, weight, adam, moments)
        self.fitted = True
        return self

    def _step(self, picked, made, y, weight, adam, moments) -> None:
        a, b, m = (np.concatenate([made[d][k] for d in picked]) for k in range(3))
        counts = np.array([len(made[d][0]) for d in picked])
        x, p = self.encode(a, b, m), self.p
        f = self.forward(x, counts)
        g = ((sigmoid(f["z"]) - y[picked]) * weight[picked] / len(picked)).astype(np.float32)
        back_bag = g[:, None] * p["out"]
        doc, al, h = f["doc"], f["weights"], f["h"]
        per = back_bag[doc]
        score = (per * h).sum(axis=1)
        de = al * (score - np.add.reduceat(al * score, f["starts"])[doc])
        gate = f["tv"] * f["su"]
        dg = de[:, None] * p["w"]
        dt, ds = dg * f["su"] * (1 - f["tv"] ** 2), dg * f["tv"] * f["su"] * (1 - f["su"])
        dh = per * al[:, None] + dt @ p["v"].T + ds @ p["u"].T
        dpre = dh * (f["pre"] > 0)
        decay = 1e-4
        grads = {"w1": x.T @ dpre + decay * p["w1"], "b1": dpre.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "w": gate.T @ de, "out": f["bag"].T @ g + decay * p["out"], "base": g.sum(keepdims=True)}
        dx = (dpre @ p["w1"].T)[:, :DIM]
        adam.step(grads)
        dx /= np.maximum(1, (a >= 0).sum(axis=1, keepdims=True))
        total = np.zeros_like(self.shapes)
        for ids in (a, b):
            np.add.at(total, ids.ravel(), np.repeat(dx, ids.shape[1], axis=0))  # -1 is the last row
        total[-1] = 0
        moments += (total**2).mean(axis=1, keepdims=True)
        self.shapes -= 0.02 * total / (np.sqrt(moments) + 1e-6)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Scorer:
    """Learn from at most per_class whole texts of each label."""
    model = Scorer().fit(labelled_sample(docs, labels, "quality", per_class))
    release()  # the sample's memory goes back before the driver plans on
    return model


def with_scores(df: DataFrame, model: Scorer, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of df, and the score of every whole text."""
    model.stamp = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work():
        words = worker_state(("quality", shared.value.stamp), word_table)
        return lambda x: pa.array(shared.value.attend(x.to_pylist(), words)[0], pa.float64())

    return append_column(df, text, "double", name, work)


def score_column(df: DataFrame, model: Scorer, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score, passages, and the passage that weighs most with its weight, for every whole text."""
    model.stamp = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SHAPES and DIM
    kind = df.schema[key].dataType.simpleString()

    def run(x: dict) -> dict:
        scores, weights, counts = shared.value.attend(x["t"], worker_state(("quality", shared.value.stamp), word_table))
        starts = np.cumsum(counts) - counts
        tops = [int(weights[s : s + n].argmax()) for s, n in zip(starts, counts)]
        return {"k": x["k"], "score": scores, "passages": counts, "top_passage": tops, "top_weight": weights[starts + np.array(tops, np.int64)].astype(np.float64)}

    schema = f"k {kind}, score double, passages bigint, top_passage bigint, top_weight double"
    return map_rows(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), schema, run, ["k", "t"]).withColumnRenamed("k", key)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_column(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages", "top_passage", "top_weight")

"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of widths 1, 2 and 3, max pooling
over the whole text, a dense layer; trained in numpy on every labelled row, thresholds calibrated by language.

Training is dealt to groups of labelled rows by a hash of the id, some thousand rows each. In every round each group
goes on from the common model over its own rows, and the groups' moves are averaged: a row of the embeddings over the
groups that moved it, all else over all groups. Moves are added as integers, so the model doesn't depend on how groups lie
in tasks; what reaches the driver is bounded by the model's size, not by rows. With one group this is plain training.

A word's embedding is the sum of two rows picked by independent hashes (one shared row alone doesn't make two
words alike) and a row picked by its first four characters. The language that picks a threshold is read from
the text itself, by its function words; neither the tables' language, source nor id is an input. A score is
1 / (1 + exp(threshold - logit)): 0.5 means the threshold of its language.

Cases: null and empty texts score as a text without words; without labels of both kinds every score is 0;
repeated rows score alike; an empty table gives no rows; extra columns are kept, those named like the new ones
are replaced. Texts are read whole; positions are worked through in blocks of bounded size.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import Adam, Words, append_column, bucket_of, cut, labelled_rows, map_rows, release, released, sigmoid, worker_state
from wordloom.session import materialise, table, written
from wordloom.session import release as drop_tables

BUCKETS, STEMS, DIM, FILTERS, WIDTHS = 1 << 16, 1 << 14, 16, 8, (1, 2, 3)
BLOCK = 1 << 16
#: Embedding rows a, b and c, and the dense parts behind them, as rows of DIM numbers and a moment, in one numbering.
STARTS = (0, BUCKETS, 2 * BUCKETS)
ROWS = 2 * BUCKETS + STEMS
#: Moves of parameters are added as multiples of this, so that no order of adding matters.
UNIT = 2.0**-40
#: Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with it as be this on by at from are not".split(),
    "de": "der die und das ist den von zu mit sich des auf für nicht dem ein eine als auch im".split(),
    "fr": "le les des et est une dans du pour qui sur pas au ne ce il elle sont par avec".split(),
    "es": "el los las del y en un por con no una su para es al lo como más pero sus".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _hashes(words: list[str]) -> np.ndarray:
    out = np.empty((len(words), 3), np.int32)
    for k, w in enumerate(words):
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out[k] = h & (BUCKETS - 1), zlib.adler32(w.encode("utf-8", "surrogatepass"), h) * 2654435761 >> 8 & (BUCKETS - 1), zlib.crc32(w[:4].encode("utf-8", "surrogatepass")) & (STEMS - 1)
    return out


_FLAGS = {w: [float(w in FUNCTION_WORDS[g]) for g in LANGUAGES] for g in LANGUAGES for w in FUNCTION_WORDS[g]}


class Classifier:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = (0.05 * r.standard_normal((BUCKETS, DIM))).astype(np.float32)
        self.b = (0.05 * r.standard_normal((BUCKETS, DIM))).astype(np.float32)
        self.c = (0.05 * r.standard_normal((STEMS, DIM))).astype(np.float32)
        #: By width: (width, DIM, FILTERS).
        self.w = {k: (r.standard_normal((k, DIM, FILTERS)) / np.sqrt(k * DIM)).astype(np.float32) for k in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (np.abs(r.standard_normal(FILTERS * len(WIDTHS))) * 0.3).astype(np.float32)
        self.out[1::2] *= -1
        self.base = np.zeros(1, np.float32)
        self.thresholds = dict.fromkeys((*LANGUAGES, ""), 0.0)
        self.fitted = False

    # -- forward ---------------------------------------------------------------------------------

    def rows(self, words: list[str]) -> np.ndarray:
        """Embedding and language flags of words."""
        h = _hashes(words)
        flags = np.array([_FLAGS.get(w, (0.0,) * len(LANGUAGES)) for w in words], np.float32)
        return np.concatenate((self.a[h[:, 0]] + self.b[h[:, 1]] + self.c[h[:, 2]], flags), axis=1)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """x has max(WIDTHS) - 1 rows more than positions come out."""
        n = len(x) - max(WIDTHS) + 1
        parts = []
        for k in WIDTHS:
            y = x[:n] @ self.w[k][0]
            for j in range(1, k):
                y += x[j : j + n] @ self.w[k][j]
            parts.append(y)
        return np.concatenate(parts, axis=1) + self.bias

    def logits(self, texts: list[str | None], words: Words) -> tuple[np.ndarray, list[str]]:
        slots = words.look_up([words_of(t) for t in texts])
        return self.pooled(slots, words.rows)

    def pooled(self, slots: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Logits and languages of texts given by their words' rows in a matrix like that of Words."""
        pad = np.zeros(max(WIDTHS) - 1, np.int32)
        flat = np.concatenate([p for s in slots for p in (s if len(s) else pad[:1], pad)])
        sizes = np.array([max(1, len(s)) + len(pad) for s in slots])
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(slots)), sizes)
        real = np.ones(len(flat), bool)
        for j in range(1, len(pad) + 1):
            real[ends - j] = False
        best = np.full((len(slots), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        votes = np.zeros((len(slots), len(LANGUAGES)), np.float32)
        for at in range(0, len(flat), BLOCK):
            part = flat[at : at + BLOCK + len(pad)]
            x = rows[part]
            if len(part) < BLOCK + len(pad):
                x = np.concatenate((x, np.zeros((len(pad), x.shape[1]), np.float32)))
            n = len(x) - len(pad)
            keep = real[at : at + n]
            y = self.convolve(x[:, :DIM])[keep]
            own = doc[at : at + n][keep]
            if not len(own):
                continue
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ids = own[starts]
            best[ids] = np.maximum(best[ids], np.maximum.reduceat(y, starts, axis=0))
            votes[ids] += np.add.reduceat(x[:n, DIM:][keep], starts, axis=0)
        z = np.maximum(best, 0) @ self.out + self.base[0]
        told = [LANGUAGES[int(v.argmax())] if v.max() > 0 else "" for v in votes]
        return z, told

    def score(self, texts: list[str | None], words: Words) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        z, told = self.logits(texts, words)
        return sigmoid(z.astype(np.float64) - np.array([self.thresholds[g] for g in told]))

    def words(self) -> Words:
        return Words(self.rows, DIM + len(LANGUAGES))

    # -- training --------------------------------------------------------------------------------

    def fit(self, sample: list[tuple[int, int, str]], **how) -> Classifier:
        """Learn from (bucket, label, text) in memory, as one group."""
        return self.learn(Here(Group.of(0, sample)), **how)

    def learn(self, groups: Here | Dealt, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 11, least: int = 3) -> Classifier:
        """Logistic loss, both labels weighing alike. Every fourth part of the rows (one bucket) doesn't train but
        calibrates, unless it has under 40 texts of either label."""
        number = groups.totals()  # by bucket 1 or not, and label
        if not number.sum(axis=0).all():
            return self
        aside = bool(number[1].min() >= 40)
        train = number[0] if aside else number.sum(axis=0)
        mean = train[1] / train.sum()
        weight = (0.5 / max(1 - mean, 1e-6), 0.5 / max(mean, 1e-6))
        often = groups.tally(lambda g: g.spread(aside)) >= least  # rows of few texts don't train, their words have but the stem's row
        run = Training(self, weight, batch, rate, seed, aside, often)
        for _ in range(epochs):
            groups.round(run)
            run.rounds += 1
        used = groups.tally(lambda g: g.used(aside, often)) > 0
        for rows, start in zip((self.a, self.b, self.c), STARTS):
            rows[~used[start : start + len(rows)]] = 0
        self.fitted = True
        self.thresholds = groups.thresholds(self, aside)
        return self

    def _step(self, picked, ids, hashes, common, y, weight, adam, dense, moments, pad, r) -> None:
        grads = {k: np.zeros_like(v) for k, v in dense.items()}
        places, shares, frequent = [], [], []
        kernels = np.concatenate([self.w[k][j] for k in WIDTHS for j in range(k)], axis=1)
        for d in picked:
            own = ids[d]
            own = own[r.random(len(own)) > 0.25] if len(own) > 4 else own  # word dropout
            h, n = hashes.take(own, axis=0), max(1, len(own))
            x = np.zeros((n + pad, DIM), np.float32)
            x[: len(own)] = (self.a.take(h[:, 0], axis=0) + self.b.take(h[:, 1], axis=0)) * common.take(own, axis=0) + self.c.take(h[:, 2], axis=0)
            y_all, at, parts = x @ kernels, 0, []
            for k in WIDTHS:
                part = y_all[:n, at : at + FILTERS]
                for j in range(1, k):
                    part = part + y_all[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                parts.append(part)
                at += k * FILTERS
            z = np.concatenate(parts, axis=1) + self.bias
            top = z.argmax(axis=0)
            pooled = z[top, np.arange(z.shape[1])]
            act = np.maximum(pooled, 0)
            g = float(sigmoid(act @ self.out + self.base[0]) - y[d]) * weight[d] / len(picked)
            grads["out"] += g * act
            grads["base"] += g
            back = g * self.out * (pooled > 0)
            grads["bias"] += back
            for m, k in enumerate(WIDTHS):
                cols = slice(m * FILTERS, (m + 1) * FILTERS)
                gk = back[cols]
                met = top[cols] + np.arange(k)[:, None]
                grads[f"w{k}"] += x[met].transpose(0, 2, 1) * gk
                hit = (met < len(own)) & (gk != 0)
                words = own[met[hit]]
                places.append(hashes[words])
                shares.append((self.w[k] * gk).transpose(0, 2, 1)[hit])
                frequent.append(common[words, 0] > 0)
        adam.step(grads)
        all_h, all_dx, often = np.concatenate(places), np.concatenate(shares), np.concatenate(frequent)
        for name, column, rows in (("a", 0, self.a), ("b", 1, self.b), ("c", 2, self.c)):
            h, dx = (all_h[often], all_dx[often]) if column < 2 else (all_h, all_dx)
            if len(h):
                order = np.argsort(h[:, column], kind="stable")
                at, starts = np.unique(h[order, column], return_index=True)
                g = np.add.reduceat(dx[order], starts, axis=0)
                moments[name][at] += (g * g).mean(axis=1)
                rows[at] -= 0.05 * g / (np.sqrt(moments[name][at]) + 1e-6)[:, None]


class Group:
    """Labelled rows that train in one go: the hashes and languages of their words, and each row's words by number."""

    def __init__(self, number: int, hashes: np.ndarray, flags: np.ndarray, ids: list[np.ndarray], y: np.ndarray, bucket: np.ndarray):
        self.number, self.hashes, self.flags, self.ids, self.y, self.bucket = number, hashes, flags, ids, y, bucket

    @staticmethod
    def of(number: int, sample: Iterable[tuple[int, int, str]]) -> Group:
        known: dict[str, int] = {}
        ids, y, bucket = [], [], []
        for b, label, text in sample:
            words = words_of(text)
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            y.append(label)
            bucket.append(b)
        flags = np.array([_FLAGS.get(w, (0.0,) * len(LANGUAGES)) for w in known], np.int8).reshape(-1, len(LANGUAGES))
        return Group(number, _hashes(list(known)), flags, ids, np.array(y, np.int8), np.array(bucket, np.int8))

    def stored(self) -> dict:
        flat = np.concatenate([np.empty(0, np.int32), *self.ids])
        sizes = np.array([len(i) for i in self.ids], np.int32)
        made = {"hashes": self.hashes, "flags": self.flags, "flat": flat, "sizes": sizes, "y": self.y, "bucket": self.bucket}
        return {"number": self.number} | {k: v.tobytes() for k, v in made.items()} | dict(zip(("train0", "train1", "aside0", "aside1"), self.totals().ravel().tolist()))

    @staticmethod
    def read(row: dict) -> Group:
        part = lambda k, kind: np.frombuffer(row[k], kind)
        ids = np.split(part("flat", np.int32), np.cumsum(part("sizes", np.int32).astype(np.int64)))[:-1]
        return Group(row["number"], part("hashes", np.int32).reshape(-1, 3), part("flags", np.int8).reshape(-1, len(LANGUAGES)), ids, part("y", np.int8), part("bucket", np.int8))

    def totals(self) -> np.ndarray:
        return np.array([[((self.bucket == 1) == a)[self.y == v].sum() for v in (0, 1)] for a in (False, True)], np.int64)

    def train(self, aside: bool) -> np.ndarray:
        return np.flatnonzero(self.bucket != 1) if aside else np.arange(len(self.y))

    def spread(self, aside: bool) -> np.ndarray:
        """How many training texts hold a word of each embedding row."""
        got = np.zeros(ROWS, np.int64)
        for k in self.train(aside):
            h = self.hashes[np.unique(self.ids[k])]
            for column, start in enumerate(STARTS):
                got[np.unique(h[:, column]) + start] += 1
        return got

    def common(self, often: np.ndarray) -> np.ndarray:
        return often[self.hashes[:, 0]] & often[self.hashes[:, 1] + BUCKETS]

    def used(self, aside: bool, often: np.ndarray) -> np.ndarray:
        """Which embedding rows training texts use: a and b by words common enough, c by all."""
        met = np.zeros(len(self.hashes), bool)
        for k in self.train(aside):
            met[self.ids[k]] = True
        got, own = np.zeros(ROWS, np.int64), met & self.common(often)
        for column, start in enumerate(STARTS):
            got[self.hashes[own if column < 2 else met, column] + start] = 1
        return got

    def judged(self, model: Classifier, aside: bool, at_once: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, language and label of the rows that calibrate."""
        use = np.flatnonzero(self.bucket == 1) if aside else np.arange(len(self.y))
        h = self.hashes
        rows = np.concatenate((model.a[h[:, 0]] + model.b[h[:, 1]] + model.c[h[:, 2]], self.flags.astype(np.float32)), axis=1)
        rows = np.concatenate((np.zeros((1, rows.shape[1]), np.float32), rows))
        parts = [model.pooled([self.ids[k] + 1 for k in use[at : at + at_once]], rows) for at in range(0, len(use), at_once)]
        return np.concatenate([np.empty(0, np.float32), *(z for z, _ in parts)]), np.array([g for _, told in parts for g in told], object), self.y[use]


class Training:
    """A model on its way, with the optimiser's state."""

    def __init__(self, model: Classifier, weight: tuple[float, float], batch: int, rate: float, seed: int, aside: bool, often: np.ndarray):
        self.model, self.weight, self.batch, self.seed, self.aside, self.often, self.rounds = model, weight, batch, seed, aside, often, 0
        self.dense = {f"w{k}": model.w[k] for k in WIDTHS} | {"bias": model.bias, "out": model.out, "base": model.base}
        self.adam = Adam(self.dense, rate)
        self.moments = {"a": np.zeros(BUCKETS, np.float32), "b": np.zeros(BUCKETS, np.float32), "c": np.zeros(STEMS, np.float32)}

    def go(self, group: Group) -> None:
        """Once over a group's training rows."""
        train, r = group.train(self.aside), np.random.default_rng((self.seed, self.rounds, group.number))
        ids, y = [group.ids[k] for k in train], group.y[train].astype(np.float32)
        weight = np.where(y == 1, self.weight[1], self.weight[0]).astype(np.float32)
        own, order = group.common(self.often).astype(np.float32)[:, None], r.permutation(len(train))
        for at in range(0, len(order), self.batch):
            self.model._step(order[at : at + self.batch], ids, group.hashes, own, y, weight, self.adam, self.dense, self.moments, max(WIDTHS) - 1, r)

    def parts(self) -> list[np.ndarray]:
        return [x for d in (self.dense, self.adam.m, self.adam.v) for x in d.values()]

    def numbers(self) -> np.ndarray:
        """All that training moves: embedding rows with their moments, then the dense parts and the count of steps."""
        m = self.model
        rows = np.concatenate([np.column_stack((x, self.moments[k])) for k, x in (("a", m.a), ("b", m.b), ("c", m.c))])
        flat = np.concatenate([*(x.ravel() for x in self.parts()), [self.adam.n]]).astype(np.float32)
        return np.concatenate((rows, np.resize(np.append(flat, np.zeros(-len(flat) % (DIM + 1), np.float32)), (-(-len(flat) // (DIM + 1)), DIM + 1))))

    def set(self, numbers: np.ndarray) -> None:
        for k, start in zip("abc", STARTS):
            x = getattr(self.model, k)
            x[:], self.moments[k][:] = numbers[start : start + len(x), :DIM], numbers[start : start + len(x), DIM]
        flat, at = numbers[ROWS:].ravel(), 0
        for x in self.parts():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.adam.n = round(flat[at])


def best_cuts(z: np.ndarray, told: np.ndarray, y: np.ndarray) -> dict[str, tuple[int, int, float]]:
    """Per language ("": all) the numbers of both labels and the threshold of fewest weighted errors (a clean text
    lost counts twice), in the middle of its widest range."""
    found = {}
    for g in ("", *LANGUAGES):
        own = np.ones(len(y), bool) if g == "" else told == g
        zp, zn = np.sort(z[own & (y == 1)]), np.sort(z[own & (y == 0)])
        if len(zp) and len(zn):
            at = np.unique(z[own]).astype(np.float64)
            cuts = np.concatenate(([at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]))
            gaps = np.concatenate(([0], at[1:] - at[:-1], [0]))
            errors = np.searchsorted(zp, cuts) * len(zn) + 2 * (len(zn) - np.searchsorted(zn, cuts)) * len(zp)
            good = np.flatnonzero(errors == errors.min())
            found[g] = len(zn), len(zp), float(cuts[good[gaps[good].argmax()]])
    return found


def settled(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """A language with under 15 texts of either label takes the threshold of all."""
    return {g: found[g][2] if g == "" or min(found.get(g, (0, 0))[:2]) >= 15 else found[""][2] for g in ("", *LANGUAGES)}


class Here:
    """One group in memory."""

    def __init__(self, group: Group):
        self.group = group

    def totals(self) -> np.ndarray:
        return self.group.totals()

    def tally(self, count) -> np.ndarray:
        return count(self.group)

    def round(self, run: Training) -> None:
        run.go(self.group)

    def thresholds(self, model: Classifier, aside: bool) -> dict[str, float]:
        return settled(best_cuts(*self.group.judged(model, aside)))


class Dealt:
    """Groups of labelled rows (id, label, bucket, text), a row of the shared folder each."""

    def __init__(self, rows: DataFrame, groups: int):
        arrow = pa.schema([("number", pa.int32()), *((k, pa.binary()) for k in ("hashes", "flags", "flat", "sizes", "y", "bucket")), *((k, pa.int64()) for k in ("train0", "train1", "aside0", "aside1"))])

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = []

            def sample():
                last = None
                for batch in released(batches):
                    for piece in cut(batch):
                        number[:] = [piece.column(0)[0].as_py()]
                        for _, key, label, bucket, text in zip(*(c.to_pylist() for c in piece.columns)):
                            if key != last:  # of several texts of an id the smallest comes first
                                yield bucket, label, text
                            last = key

            group = Group.of(0, sample())
            if number:
                group.number = number[0]
                yield pa.RecordBatch.from_pylist([group.stored()], schema=arrow)

        number = F.pmod(F.xxhash64("__id"), F.lit(groups)).cast("int")
        dealt = rows.select(number.alias("__group"), "__id", "__label", "__bucket", "__text").repartitionById(groups, F.col("__group")).sortWithinPartitions("__id", "__text")
        kinds = ", ".join(f"{f.name} {'int' if f.name == 'number' else 'binary' if f.type == pa.binary() else 'bigint'}" for f in arrow)
        self.spark = rows.sparkSession
        self.stored = materialise(dealt.mapInArrow(pack, kinds))
        #: Tasks are few, for each brings a model's size of moves.
        self.tasks = self.spark.sparkContext.defaultParallelism
        self.groups = self.stored.coalesce(self.tasks)

    def each(self, work, schema: str) -> DataFrame:
        """work() takes a task's groups, one at a time in memory, and yields record batches."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from work(Group.read(row) for batch in released(batches) for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())

        return self.groups.select("number", "hashes", "flags", "flat", "sizes", "y", "bucket").mapInArrow(run, schema)

    def totals(self) -> np.ndarray:
        got = self.stored.agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("train0", "train1", "aside0", "aside1"))).first()
        return np.array(list(got), np.int64).reshape(2, 2)

    def summed(self, add, shape: tuple[int, int], last, fan: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """The sum over all groups of what add(total, group) adds to an array of integers: the rows that aren't all 0, and
        what last(their numbers, their sums) makes of them. Each task writes one sum of its groups, `fan` of these at a time
        are added up until one is left, which comes in small pieces; they go when it is read."""

        def packed(total):
            at = np.flatnonzero(total.any(axis=1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at, total[at])], names=["at", "sums"])

        def first(groups):
            total = np.zeros(shape, np.int64)
            for g in groups:
                add(total, g)
            yield packed(total)

        def together(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(shape, np.int64)
            for batch in released(batches):
                for k in range(batch.num_rows):
                    at, sums = (np.frombuffer(c[k].as_buffer(), kind) for c, kind in zip(batch.columns, (np.int32, np.int64)))
                    total[at] += sums.reshape(-1, shape[1])
            return total

        def more(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield packed(together(batches))

        def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = together(batches)
            at = np.flatnonzero(total.any(axis=1)).astype(np.int32)
            made = last(at, total[at]).astype(np.float32)
            cuts = [(at[k : k + 2048].tobytes(), made[k : k + 2048].tobytes()) for k in range(0, len(at), 2048)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*cuts)] if cuts else [pa.array([], pa.binary())] * 2, names=["at", "sums"])

        before, schema, n = written(), "at binary, sums binary", self.tasks
        parts = materialise(self.each(first, schema))
        while n > fan:
            n = -(-n // fan)
            parts = materialise(parts.coalesce(n).mapInArrow(more, schema))
        rows = parts.coalesce(1).mapInArrow(pieces, schema).collect()
        drop_tables(before, 0)
        self.spark.sparkContext._jvm.System.gc()  # else each round's arrays stay in the driver's heap for long
        return np.frombuffer(b"".join(r["at"] for r in rows), np.int32), np.frombuffer(b"".join(r["sums"] for r in rows), np.float32)

    def tally(self, count, most: int = 1 << 20) -> np.ndarray:
        """Counts by embedding row, those above `most` as `most`."""

        def add(total, g):
            total[:, 0] += count(g)

        at, sums = self.summed(add, (ROWS, 1), lambda at, sums: np.minimum(sums, most))
        total = np.zeros(ROWS, np.int64)
        total[at] = sums
        return total

    def round(self, run: Training) -> None:
        shared = self.spark.sparkContext.broadcast(run)

        def add(total, g):
            own, start = copy.deepcopy(shared.value), shared.value.numbers()
            own.go(g)
            start = own.numbers() - start
            at = np.flatnonzero((start != 0).any(axis=1))
            total[at, 0] += 1
            total[at, 1:] += np.rint(start[at].astype(np.float64) / UNIT).astype(np.int64)

        def mean(at, sums):
            n = np.where(at < ROWS, sums[:, 0], sums[:, 0][at >= ROWS].max(initial=1))  # the dense parts belong to every group
            return sums[:, 1:] * UNIT / n[:, None]

        at, moves = self.summed(add, (len(run.numbers()), DIM + 2), mean)
        shared.destroy()
        numbers = run.numbers()
        numbers[at] += moves.reshape(-1, DIM + 1)
        run.set(numbers)
        release()

    def thresholds(self, model: Classifier, aside: bool) -> dict[str, float]:
        """best_cuts over the rows of all groups. Logits are counted by value, the values lie in bins by their
        upper 16 bits; what reaches the driver is a row a bin, and the cuts of a bin meet in one task."""
        shared = self.spark.sparkContext.broadcast(model)

        def work(groups):
            for g in groups:
                z, told, y = g.judged(shared.value, aside)
                z = z.astype(np.float32) + np.float32(0)  # one zero
                seen = Counter((own, v, int(label)) for v, tongue, label in zip(z.tolist(), told, y) for own in {"", tongue})
                bits = np.array([v for _, v, _ in seen], np.float32).view(np.int32)
                bins = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> 16
                made = [[own for own, _, _ in seen], bins, [v for _, v, _ in seen], [n * (1 - label) for (_, _, label), n in seen.items()], [n * label for (_, _, label), n in seen.items()]]
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], names=["g", "bin", "z", "n0", "n1"])

        judged = self.each(work, "g string, bin int, z double, n0 bigint, n1 bigint")
        values = materialise(judged.groupBy("g", "bin", "z").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
        shared.destroy()
        bins = values.groupBy("g", "bin").agg(F.sum("n0"), F.sum("n1"), F.min("z"), F.max("z")).collect()
        total, ends, edges = {}, {}, []
        for g, at, n0, n1, low, high in sorted(bins):
            before = total.get(g, (0, 0))
            edges.append((g, at, *before, ends.get(g)))
            total[g], ends[g] = (before[0] + n0, before[1] + n1), high
        edges = self.spark.createDataFrame([(g, at, b0, b1, end, *total[g]) for g, at, b0, b1, end in edges if min(total[g])], "g string, bin int, b0 bigint, b1 bigint, end double, t0 bigint, t1 bigint")
        order = W.partitionBy("g", "bin").orderBy("z")
        below = lambda c: F.coalesce(F.sum(f"n{c}").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col(f"b{c}")
        cuts = values.join(F.broadcast(edges), ["g", "bin"]).select("g", "z", "t0", "t1", F.coalesce(F.lag("z").over(order), "end").alias("last"), below(0).alias("u0"), below(1).alias("u1"))
        cuts = cuts.select("g", F.expr("u1 * t0 + 2 * (t0 - u0) * t1").alias("errors"), F.coalesce(F.col("last") - F.col("z"), F.lit(0.0)).alias("gap"), "z", F.coalesce((F.col("z") + F.col("last")) / 2, F.col("z") - 1).alias("cut"))
        found = {}
        for g, (errors, gap, z, at) in cuts.groupBy("g").agg(F.min(F.struct("errors", "gap", "z", "cut"))).collect():
            n0, n1 = total[g]
            last = (n1 * n0, 0.0, ends[g] + 1, ends[g] + 1)  # beyond all
            found[g] = n0, n1, min((errors, gap, z, at), last)[3]
        return settled(found)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, group_bytes: int = 24 << 20) -> Classifier:
    """Learn from every labelled whole text but those held out, in groups of about `per_class` rows of the more
    frequent label, or of about `group_bytes` of text if that is less."""
    before = written()
    rows = labelled_rows(docs, labels, "toxic")
    size = rows.groupBy("__label").agg(F.count(F.lit(1)), F.sum(F.octet_length("__text"))).collect()
    model = Classifier()
    if len(size) == 2:
        model.learn(Dealt(rows, max(1, -(-max(n for _, n, _ in size) // per_class), -(-sum(b for *_, b in size) // group_bytes))))
    drop_tables(before, 0)
    release()  # the model's copies go back before the driver plans on
    return model


def with_scores(df: DataFrame, model: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of df, and the score of every whole text."""
    model.stamp = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work():
        words = worker_state(("toxicity", shared.value.stamp), shared.value.words)
        return lambda x: pa.array(shared.value.score(x.to_pylist(), words), pa.float64())

    return append_column(df, text, "double", name, work)


def score_column(df: DataFrame, model: Classifier, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score of every whole text."""
    model.stamp = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS, STEMS and DIM
    kind = df.schema[key].dataType.simpleString()

    def run(x: dict) -> dict:
        words = worker_state(("toxicity", shared.value.stamp), shared.value.words)
        return {"k": x["k"], "score": shared.value.score(x["t"], words)}

    return map_rows(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), f"k {kind}, score double", run, ["k", "t"]).withColumnRenamed("k", key)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_column(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

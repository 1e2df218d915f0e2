"""Vocabularies: nearest words, histograms, K-means.

vocabulary: word_id, center (array<double>). Words are broadcast as a matrix, WORD_BYTES of them at a time, and compared with
descriptors in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  reached as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.arrow import matrix, nearest_rows, unit_rows, with_columns
from wordloom.functions.vectors import wide
from wordloom.session import materialise

#: Bytes of centres that are broadcast at a time; more are met pass by pass, each keeping the nearest so far.
WORD_BYTES = 64 << 20
#: Rows that a vocabulary's first centres are found on, the first by a hash of their vectors.
SAMPLE = 20_000
METRICS = ("euclidean", "cosine")


def _blocks(vocabulary: DataFrame, unit: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, centres and their squared norms, in order of ids."""
    words = vocabulary.select("word_id", wide(F.col("center")).alias("center"))
    first = words.select(F.size("center")).first()
    if first is None:
        raise ValueError("a vocabulary without words")
    passes = max(1, -(-words.count() * 8 * first[0] // WORD_BYTES))
    for k in range(passes):
        part = words if passes == 1 else words.where(F.pmod(F.xxhash64("word_id"), F.lit(passes)) == k)
        got = part.orderBy("word_id").toArrow().combine_chunks()
        if len(got):
            m = matrix(got.column(1).chunk(0))
            m = unit_rows(m) if unit else m
            yield got.column(0).chunk(0), m, (m * m).sum(axis=1)


def assign(descriptors: DataFrame, vocabulary: DataFrame, metric: str = "euclidean", measure: str | None = None) -> DataFrame:
    """All columns of descriptors (vec among them) and word_id, the nearest word's; distances count to 9 places, ties go to the
    smaller id, a null vector has no word. cosine: by vectors and centres of unit length. measure adds a column of that name:
    d2, the squared distance, or cosine, of the vector and its word's centre."""
    if metric not in METRICS or measure not in (None, "d2", "cosine"):
        raise ValueError(f"no metric {metric!r} or measure {measure!r}")
    spark, unit = descriptors.sparkSession, metric == "cosine"
    kind = vocabulary.schema["word_id"].dataType.simpleString()
    columns = [c for c in descriptors.columns if c not in ("word_id", measure)]
    found, last = descriptors, None
    for block in _blocks(vocabulary, unit):
        shared = spark.sparkContext.broadcast(block)

        def work(vec, *best, shared=shared):
            ids, m, norms = shared.value
            there = vec.is_valid().to_numpy(zero_copy_only=False)
            x = matrix(vec.filter(pa.array(there))) if there.any() else np.empty((0, m.shape[1]))
            x = unit_rows(x) if unit else x
            place, d = nearest_rows(x, m, norms, ids.to_numpy(zero_copy_only=False))
            cosine = (unit_rows(x) * unit_rows(m[place])).sum(axis=1)
            at = np.full(len(vec), -1)
            at[there] = np.arange(len(x))
            index = pa.array(at, mask=~there)
            made = [ids.take(pa.array(place)).take(index), pa.array(d).take(index), pa.array(cosine).take(index)]
            if best:  # the nearest of the words before
                old = np.round(best[1].to_numpy(zero_copy_only=False), 9), best[0].to_numpy(zero_copy_only=False)
                new = np.round(made[1].to_numpy(zero_copy_only=False), 9), made[0].to_numpy(zero_copy_only=False)
                keep = pa.array((old[0] < new[0]) | ((old[0] == new[0]) & (old[1] < new[1])))
                made = [pa.compute.if_else(keep, b, n) for b, n in zip(best, made)]
            return made

        inputs = [wide(F.col("vec")), *([F.col(c) for c in last] if last else [])]
        last = ("__word", "__d2", "__cosine")
        found = with_columns(found, inputs, f"__word {kind}, __d2 double, __cosine double", work)
    own = {"d2": "__d2", "cosine": "__cosine"}
    return found.select(*[F.col(f"`{c}`") for c in columns], F.col("__word").alias("word_id"), *([F.col(own[measure]).alias(measure)] if measure else []))


def encode(descriptors: DataFrame, vocabulary: DataFrame, metric: str = "euclidean") -> DataFrame:
    """occurrence of the nearest words."""
    from wordloom.operators.stats import occurrence

    return occurrence(assign(descriptors, vocabulary, metric))


def _moved(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the points nearest to each centre (centres without points stay), and how many those are. Every task adds up its
    points for each centre; a row per task, centre and dimension is shuffled."""
    spark, (k, dim) = points.sparkSession, centres.shape
    shared = spark.sparkContext.broadcast((centres, (centres * centres).sum(axis=1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, norms = shared.value
        sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            place, _ = nearest_rows(x, m, norms, np.arange(k))
            order = np.argsort(place, kind="stable")
            own, first = np.unique(place[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(x[order], first)
                counts += np.bincount(place, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], names=["word", "n", "sums"])

    parts = points.select("vec").mapInArrow(run, "word bigint, n bigint, sums array<double>")
    means = parts.select("word", "n", F.posexplode("sums").alias("dim", "x")).groupBy("word", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    got = means.toArrow()  # as many rows as the centres have numbers
    word, at, x, n = (got.column(i).to_numpy() for i in range(4))
    moved, sizes = centres.copy(), np.zeros(k, np.int64)
    moved[word, at] = x / n
    sizes[word] = n
    return moved, sizes


def _words(spark, centres: np.ndarray) -> DataFrame:
    rows = pa.table({"word_id": pa.array(range(len(centres)), pa.int32()), "center": pa.array(list(centres), pa.list_(pa.float64()))})
    return spark.createDataFrame(rows, "word_id int, center array<double>")


def lloyd(points: DataFrame, k: int, rounds: int) -> DataFrame:
    """Deterministic K-means of points (id, vec): the k smallest ids are the first centres; centres without points stay."""
    pts = materialise(points.select("id", wide(F.col("vec")).alias("vec")).where("vec is not null"))
    first = pts.orderBy("id").limit(k).toArrow()
    if len(first) < k:
        raise ValueError(f"fewer than {k} vectors; raise n_candidates_per_class")
    centres = matrix(first.column(1).combine_chunks())
    for _ in range(rounds):
        centres, _ = _moved(pts, centres)
    return _words(points.sparkSession, centres)


def spread_centres(x: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """k rows to begin with: each next one is the best of a few drawn with chances as the squared distances to those before
    (Arthur, Vassilvitskii 2007)."""
    norms = (x * x).sum(axis=1)
    chosen = [int(r.integers(len(x)))]
    least = np.maximum(0, norms + norms[chosen[0]] - 2 * x @ x[chosen[0]])
    for _ in range(k - 1):
        total = least.sum()
        tried = r.choice(len(x), 2 + int(np.log(k)), p=least / total) if total > 0 else r.integers(0, len(x), 1)
        d = np.minimum(least, np.maximum(0, norms + norms[tried][:, None] - 2 * x[tried] @ x.T))
        best = d.sum(axis=1).argmin()
        chosen.append(int(tried[best]))
        least = d[best]
    return x[chosen].copy()


def mini_batches(x: np.ndarray, centres: np.ndarray, batch: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    """Rounds over random batches; a centre moves to the mean of all rows that it ever won (Sculley 2010)."""
    centres, seen = centres.copy(), np.zeros(len(centres))
    for _ in range(rounds):
        own = x[r.integers(0, len(x), min(batch, len(x)))]
        place, _ = nearest_rows(own, centres, (centres * centres).sum(axis=1), np.arange(len(centres)))
        n, sums = np.bincount(place, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, place, own)
        seen += n
        won = n > 0
        centres[won] += (sums[won] - n[won, None] * centres[won]) / seen[won, None]
    return centres


def build_vocabulary(pool: DataFrame, k: int, seed: int = 42, max_iter: int = 100, metric: str = "euclidean", batch: int | None = None) -> DataFrame:
    """K-means over vec; cosine: on unit vectors with plain means, centres being normalised only when words are assigned.
    First centres come from at most SAMPLE rows by the seed; with `batch` they are moved by that many rows at a time, without by
    all of the sample; then rounds over all rows follow until the centres rest, max_iter rounds of each at most. The sample goes by
    a hash of the vectors, so the seed decides the result however rows are laid out."""
    v = wide(F.col("vec"))
    x = materialise(pool.select(v.alias("vec")).where("vec is not null"))
    if metric == "cosine":
        x = with_columns(x, [F.col("vec")], "vec array<double>", lambda vec: [pa.array(list(unit_rows(matrix(vec))), pa.list_(pa.float64()))])
        x = materialise(x)
    sample = matrix(x.orderBy(F.xxhash64("vec"), "vec").limit(max(SAMPLE, 4 * k)).toArrow().column(0).combine_chunks())
    if len(sample) < k:
        raise ValueError(f"{len(sample)} vectors for {k} words; raise n_candidates_per_class")
    r = np.random.default_rng(seed)
    centres = spread_centres(sample, k, r)
    rest = 1e-4 * sample.var(axis=0).mean()
    if batch:
        centres = mini_batches(sample, centres, batch, max_iter, r)
    else:
        for _ in range(max_iter):
            place, _ = nearest_rows(sample, centres, (centres * centres).sum(axis=1), np.arange(k))
            n, sums = np.bincount(place, minlength=k), np.zeros_like(centres)
            np.add.at(sums, place, sample)
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            shift, centres = ((moved - centres) ** 2).sum(), moved
            if shift <= rest:
                break
    for _ in range(max_iter):
        moved, _ = _moved(x, centres)
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= rest:
            break
    return _words(pool.sparkSession, centres)


def distances(descriptors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every descriptor's squared distance to its assigned word."""
    return assign(descriptors, vocabulary, measure="d2").select("image_id", "local_idx", "word_id", "d2")

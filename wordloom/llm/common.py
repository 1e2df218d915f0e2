"""What several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.session import materialise


def vocabulary_path(name: str) -> str:
    """Path of a public tokenizer file; every operator takes another path as a parameter."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ModuleNotFoundError:
        return f"/opt/tokenizers/{name}"


def library_threads(threads: int = 2) -> None:
    """How many threads the tokenizers library may use in this worker, unless the environment says so already; to be called
    before its first batch. Idle ones would wait at full load, and every core has a task of its own."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))


def bucket_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 marks held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def map_rows(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict], columns: list[str], passing: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over `columns` alone: fn gets a dict of Python lists per batch and returns a dict of lists
    or Arrow arrays for `schema`. Batches are cut by bytes, so long texts don't pile up. `passing` columns
    reach fn as Arrow arrays instead of lists."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for piece in cut(batch):
                got = fn({c: piece.column(k) if c in passing else piece.column(k).to_pylist() for k, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def append_column(df: DataFrame, column: str, kind: str, name: str, work: Callable, keep: bool = True) -> DataFrame:
    """All columns of df but one called `name` (and, unless keep, the column itself, which needn't travel back), and `name` made from `column` a batch at a time: work() is called in
    each task and returns a function from an Arrow array to an Arrow array."""
    kept = [c for c in df.columns if c != name and (keep or c != column)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.StructType.fromDDL(f"x {kind}")[0].dataType)])
    arrow = to_arrow_schema(schema)
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias(free(df, "in")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = work()
        for batch in released(batches):
            for piece in cut(batch):
                made = state(piece.column(len(kept)))
                yield pa.RecordBatch.from_arrays([*(piece.column(k).cast(f.type) for k, f in zip(range(len(kept)), arrow)), made], schema=arrow)

    return rows.mapInArrow(run, schema)


def free(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df in the shared folder with a number for each row, and that column's name."""
    name = free(df, "row")
    return materialise(df.withColumn(name, F.monotonically_increasing_id())), name


def kept_by(docs: DataFrame, key: str, decided: DataFrame, how: str, most: int = 500_000) -> DataFrame:
    """docs joined with `decided` on its first column = key; its other columns must have names of their own. The decisions are
    broadcast if they are few, counted first; else both sides are shuffled."""
    name = free(docs, "decided")
    decided = materialise(decided.toDF(name, *decided.columns[1:]))
    few = decided.count() <= most
    got = docs.join(F.broadcast(decided) if few else decided, F.col(f"`{key}`") == F.col(name), how)
    return got.drop(name)


def cut(batch: pa.RecordBatch, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most_bytes` each, a row at least."""
    n = batch.num_rows
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = 3000, most_bytes: int = 48 << 20) -> list[tuple[int, int, str]]:
    """(bucket, label, text) of a bounded sample of labelled rows to learn from: per label at most `per_class`
    documents and `most_bytes` of text, first by a hash of the id, none of bucket 0. Null labels, ids and texts don't
    count; of several labels for an id the largest does, of several texts the smallest. What reaches the driver is bounded
    by twice both."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)").where(bucket_of("__id") != 0)
    picked = [known.where(F.col("__label") == v).groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for v in (0, 1)]
    few = picked[0].unionByName(picked[1]).groupBy("__id").agg(F.max("__label").alias("__label"))
    text = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text")).where("__text is not null")
    found = text.join(F.broadcast(few), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))  # at most 2 * per_class ids are broadcast
    upto = F.sum(F.octet_length("__text")).over(W.partitionBy("__label").orderBy(F.xxhash64("__id"), "__id"))
    rows = found.withColumn("__upto", upto).where(F.col("__upto") <= most_bytes).select(bucket_of("__id").cast("int"), "__label", "__text").collect()
    return sorted((int(b), int(y), t) for b, y, t in rows)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """__id, __label, __bucket and __text of every labelled row to learn from: none of bucket 0, no null labels, ids or
    texts. Of several labels for an id the largest counts; all texts of an id are there."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)").where(bucket_of("__id") != 0)
    text = docs.select(F.col("doc_id").alias("__id"), bucket_of().cast("int").alias("__bucket"), F.col("text").cast("string").alias("__text")).where("__text is not null")
    return kept_by(text, "__id", known.groupBy("__id").agg(F.max("__label").alias("__label")), "inner")


_kept: dict = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task. Workers serve one operator after another, so only the last key's
    state is kept, and what the one before held goes back to the system."""
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one a worker gives back what it no longer holds, for it stays while others work."""
    yield from batches
    release()


class Words:
    """Words seen by a worker, each with a row of a float32 matrix; emptied when it holds `most` words.
    Row 0 is all zeros. `make` turns a list of words into their rows."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], columns: int, most: int = 150_000):
        self.make, self.columns, self.most = make, columns, most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.rows = np.zeros((1024, self.columns), np.float32)

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.slots) > self.most:
            self.clear()
        slots = self.slots
        new = list(dict.fromkeys(w for words in texts for w in words if w not in slots))
        if new:
            first, last = len(slots) + 1, len(slots) + 1 + len(new)
            if last > len(self.rows):
                self.rows = np.concatenate((self.rows[:first], np.zeros((max(last, 2 * first) - first + 1, self.columns), np.float32)))
            self.rows[first:last] = self.make(new)
            slots.update(zip(new, range(first, last)))
        get = slots.__getitem__
        return [np.fromiter(map(get, words), np.int32, len(words)) for words in texts]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, parts: dict[str, np.ndarray], rate: float):
        self.parts, self.rate, self.n = parts, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parts.items()}
        self.v = {k: np.zeros_like(v) for k, v in parts.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.parts[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(self.parts[k].dtype)

"""Rows by Arrow batches: a matrix of a list column, columns added to whatever a table has, nearest rows of a matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a batch that are worked on at a time.
PIECE_BYTES = 4 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, none null, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def with_columns(df: DataFrame, inputs: list[Column], outputs: str, work: Callable[..., list]) -> DataFrame:
    """All columns of df and `outputs` (DDL), which work(*Arrow arrays of the inputs) returns as arrays for a piece of a batch.
    Columns of df named like an output are replaced."""
    made = T.StructType.fromDDL(outputs)
    kept = [c for c in df.columns if c not in made.names]
    schema = T.StructType([*(df.schema[c] for c in kept), *made])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                columns = [piece.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
                got = work(*(piece.column(k) for k in range(len(kept), piece.num_columns)))
                yield pa.RecordBatch.from_arrays([*columns, *(x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, to_arrow_schema(made)))], schema=arrow)

    rows = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"__in{k}") for k, c in enumerate(inputs)])
    return rows.mapInArrow(run, schema)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def squared(x: np.ndarray, m: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of x to all rows of m (their squared norms given) by one product, and how far they may
    be off, a row."""
    own = (x * x).sum(axis=1)
    d = x @ m.T
    d *= -2
    d += norms
    d += own[:, None]
    return d, 16 * x.shape[1] * np.finfo(float).eps * (own + (norms.max() if len(norms) else 0))


def nearest_rows(x: np.ndarray, m: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in m of the nearest row for each row of x, and its squared distance. Distances count to 9 places, ties go
    to the smaller id: where the product leaves several candidates, the distances themselves decide."""
    place, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 512):
        own = x[at : at + 512]
        d, error = squared(own, m, norms)
        best = d.argmin(axis=1)
        near = d <= (d[np.arange(len(own)), best] + 2 * error + 2e-9)[:, None]
        for r in np.flatnonzero(near.sum(axis=1) > 1):
            few = np.flatnonzero(near[r])
            exact = np.round(((own[r] - m[few]) ** 2).sum(axis=1), 9)
            best[r] = few[np.lexsort((ids[few], exact))[0]]
        place[at : at + 512] = best
        dist[at : at + 512] = ((own - m[best]) ** 2).sum(axis=1)
    return place, dist

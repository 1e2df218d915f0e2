"""Connected components of a distributed list of links.

Every round, each node's smallest neighbour below it becomes its parent, its other ones are hooked to that
parent, and parents are followed one step further. Links live in written tables between rounds; grouping is a
partial aggregation, and the joins have one row per node on one side, so a hot node's rows can be split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import materialise


def local_forest(links: DataFrame) -> DataFrame:
    """The same components with fewer links: those within a batch become stars around their smallest node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if len(a):
                root, node = stars(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], names=["a", "b"])

    return links.mapInArrow(run, "a bigint, b bigint")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node of its component, node) for all nodes but the smallest ones."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[label[own]], nodes[own]


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """links: a, b (bigint). node, component (its smallest node) of every node that isn't the smallest of its own.
    rows: about how many links remain when those of a batch are merged."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = materialise(local_forest(links.select(lo.alias("a"), hi.alias("b")).where("a < b")).distinct(), rows)
    rows = e.count()
    while True:
        parent = e.groupBy("b").agg(F.min("a").alias("p"))
        with_parent = materialise(e.join(parent.withColumnRenamed("b", "node"), F.col("b") == F.col("node")).select("a", "b", "p"), rows)
        own = with_parent.where("a = p").select("b", "p")
        above = own.select(F.col("b").alias("up"), F.col("p").alias("pp"))
        jumped = own.join(above, F.col("p") == F.col("up"), "left").select(F.coalesce("pp", "p").alias("a"), "b", F.col("pp").isNotNull().alias("moved"))
        hooks = with_parent.where("a != p").select(F.col("p").alias("a"), F.col("a").alias("b"), F.lit(True).alias("moved"))
        e2 = materialise(jumped.unionByName(hooks).groupBy("a", "b").agg(F.max("moved").alias("moved")), rows)
        if not e2.where("moved").limit(1).count():
            return e2.select(F.col("b").alias("node"), F.col("a").alias("component"))
        e = e2.select("a", "b")

"""Candidate pools for the final vocabulary, and their audits.

assignments: image_id, local_idx, cluster_id, prob (survivors); selection: class, cluster_id, score; the rows of a
cluster are preferred by probability, then image and index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators.allocation import allocate, pick_cyclic
from wordloom.session import materialise


#: Parts that a cluster's rows are dealt to before its best are ranked.
PARTS = 64


def members(assignments: DataFrame, most: int | None = None) -> DataFrame:
    """Rows with their place in their cluster (from 1); most: no more than so many of each cluster, found part by part first,
    so that a hot cluster isn't sorted in one task."""
    order = (F.desc("prob"), "image_id", "local_idx")
    if most is not None:
        part = F.pmod(F.xxhash64("image_id", "local_idx"), F.lit(PARTS))
        place = F.row_number().over(W.partitionBy("cluster_id", "__part").orderBy(*order))
        assignments = assignments.withColumn("__part", part).withColumn("__place", place).where(F.col("__place") <= most).drop("__part", "__place")
    return assignments.withColumn("member_rank", F.row_number().over(W.partitionBy("cluster_id").orderBy(*order)))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))


def legacy_audit(selection: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per selected cluster: by how many classes, its size, and the rows taken (as many as classes, if there are)."""
    counts = selection.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("selection_count"))
    x = counts.join(cluster_sizes(assignments), "cluster_id")
    return x.withColumn("n_taken", F.least("selection_count", "cluster_size"))


def legacy_pool(selection: DataFrame, assignments: DataFrame) -> DataFrame:
    counts = selection.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("selection_count"))
    most = counts.agg(F.max("selection_count")).first()[0] or 0
    return members(assignments, most).join(counts, "cluster_id").where(F.col("member_rank") <= F.col("selection_count")).drop("selection_count")


def weighted_allocation(selection: DataFrame, assignments: DataFrame, pool_size: int) -> DataFrame:
    """Per class and selected cluster: how many rows it contributes. The pool is shared evenly by classes in their order,
    a class's part by its clusters' scores; clusters without members take none."""
    classes = selection.select("class").distinct().withColumn("__one", F.lit(1.0)).withColumn("__all", F.lit(0))
    shares = allocate(classes, ["__all"], "class", "__one", F.lit(pool_size), "class_total").select("class", "class_total")
    x = selection.join(shares, "class").join(cluster_sizes(assignments), "cluster_id")
    x = allocate(x, ["class"], "cluster_id", "score", F.col("class_total"), "n_allocated")
    return x.withColumn("n_duplicated", F.greatest(F.lit(0).cast("bigint"), F.col("n_allocated") - F.col("cluster_size")))


def weighted_pool(selection: DataFrame, assignments: DataFrame, pool_size: int) -> DataFrame:
    """Rows of the pool: class, cluster_id, slot, image_id, local_idx; a cluster that several classes chose contributes
    to each of them, and one short of members repeats them in order."""
    wanted = materialise(weighted_allocation(selection, assignments, pool_size).select("class", "cluster_id", F.col("n_allocated").alias("n")))
    most = wanted.agg(F.max("n")).first()[0] or 0  # a cluster with more members than that repeats none
    best = members(assignments, most).select("cluster_id", "member_rank", "image_id", "local_idx")
    return pick_cyclic(wanted, best, ["cluster_id"]).select("class", "cluster_id", "slot", "image_id", "local_idx")


def gather(pool: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The pool's rows with their vectors; repeated rows stay repeated."""
    return pool.join(descriptors.select("image_id", "local_idx", "vec"), ["image_id", "local_idx"])

"""Largest-remainder allocation and cyclic picks as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def allocate(buckets: DataFrame, group: list[str], bucket: str, score: str, total: Column, name: str = "n") -> DataFrame:
    """Shares of `total` in proportion to scores: whole parts first, the rest to the largest fractions, equal ones by
    bucket order; scores that are all zero share evenly. Negative scores or totals are an error. `total` may differ
    by group."""
    g = W.partitionBy(*group)
    wrong = F.raise_error(F.lit("scores and totals must not be negative"))
    x = buckets.withColumn("__t", F.when(total < 0, wrong.cast("bigint")).otherwise(total.cast("bigint")))
    x = x.withColumn("__s", F.when(F.col(score) < 0, wrong.cast("double")).otherwise(F.col(score).cast("double")))
    sums = F.sum("__s").over(g)
    share = F.when(sums > 0, F.col("__t") * F.col("__s") / sums).otherwise(F.col("__t") / F.count(F.lit(1)).over(g))
    x = x.withColumn("__share", share).withColumn("__base", F.floor("__share"))
    x = x.withColumn("__rest", F.col("__t") - F.sum("__base").over(g))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.round(F.col("__share") - F.col("__base"), 9).desc(), bucket))
    return x.withColumn(name, F.col("__base") + (place <= F.col("__rest")).cast("bigint")).drop("__t", "__s", "__share", "__base", "__rest")


def allocate_counts(spark, scores: list[float], total: int) -> list[int]:
    """The same for one short list."""
    if total < 0:
        raise ValueError("the total is negative")
    if any(s < 0 for s in scores):
        raise ValueError("a score is negative")
    if not scores:
        if total:
            raise ValueError("nothing to allocate to")
        return []
    rows = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(scores)], "g int, i int, s double")
    return [r["n"] for r in allocate(rows, ["g"], "i", "s", F.lit(total)).orderBy("i").select("n").collect()]


def pick_cyclic(wanted: DataFrame, members: DataFrame, key: list[str], rank: str = "member_rank") -> DataFrame:
    """wanted: key, n; members: key and rank from 1. A row per slot 0 .. n - 1 with member slot mod their number."""
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("__size"))
    slots = wanted.where("n > 0").join(sizes, key).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return slots.withColumn(rank, (F.col("slot") % F.col("__size") + 1).cast("int")).drop("__size").join(members, [*key, rank])

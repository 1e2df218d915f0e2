"""Incremental runs: new files of a folder are worked through once, by a file stream with availableNow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> int:
    """Apply `work` to the Parquet files of `source` that earlier calls with this checkpoint haven't seen, append to
    `sink`; how many rows this call read. A failed call is taken up where it stopped."""
    rows = spark.readStream.schema(schema).parquet(source)
    q = work(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return sum(int(p["numInputRows"]) for p in q.recentProgress)


def drain_occurrence(spark: SparkSession, source: str, sink: str, checkpoint: str) -> int:
    """Assignments (image_id, word_id) of new files into per-batch counts; sum over f to read them."""

    def batch(df: DataFrame, number: int) -> None:
        counted = df.groupBy("image_id", "word_id").agg(F.count(F.lit(1)).alias("f")).withColumn("batch", F.lit(number))
        counted.write.mode("overwrite").parquet(f"{sink}/batch={number}")  # the same batch again replaces itself

    q = spark.readStream.schema("image_id long, word_id int").parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(p["numInputRows"]) for p in q.recentProgress)

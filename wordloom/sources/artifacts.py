"""Stored artifacts: vocabularies with their settings, predictions, JSON documents."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.evaluation import with_proba_columns, with_proba_map


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_valid(spark: SparkSession, path: str) -> bool:
    """A file with bytes, or a folder that a finished job wrote."""
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return False
    status = fs.getFileStatus(p)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) if status.isDirectory() else status.getLen() > 0


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Under a temporary name first, then renamed: readers see the old or the new document."""
    jvm, p, fs = _fs(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(temp, True)
    out.write(json.dumps(value, indent=2, default=str).encode())
    out.close()
    fs.delete(p, False)
    fs.rename(temp, p)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def save_vocabulary(words: DataFrame, path: str, seed: int, metric: str) -> None:
    """word_id, center, and its settings beside."""
    words.select(F.col("word_id").cast("int").alias("word_id"), F.col("center").cast("array<double>").alias("center")).write.mode("overwrite").parquet(path)
    write_json(words.sparkSession, f"{path}.json", {"k": words.count(), "seed": seed, "metric": metric})


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(path), read_json(spark, f"{path}.json")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Any rows with a vec column; elements are stored as floats."""
    vectors.withColumn("vec", F.col("vec").cast("array<float>")).write.mode("overwrite").parquet(path)


def save_predictions(predictions: DataFrame, path: str, classes: list[str]) -> None:
    """A probability column per class, so that files of other class sets can lie beside."""
    with_proba_columns(predictions, classes).write.mode("overwrite").parquet(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return with_proba_map(spark.read.option("mergeSchema", True).parquet(path))

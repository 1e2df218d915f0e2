"""Reading tables, and cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list = []
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one machine (a local master, as in tests) gets a
    temporary folder for the session; a cluster gets an error, for its executors share no such folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _own.get(context.applicationId)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = _own[context.applicationId] = tempfile.mkdtemp(prefix="wordloom-")
    return found.rstrip("/")


#: Rows of a small table (ids and numbers) that one file should hold.
FILE_ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A small table of about `rows` rows in as many partitions as that needs, not as many as a shuffle has; tables
    below a file's rows still get up to eight."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS), min(8, -(-rows // 10_000))))


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage is cut, the files
    survive lost executors, and later readers prune columns. Files go when the driver ends.
    rows: about how many there are, where a table of a few columns would else be many tiny files."""
    if rows is not None:
        df = gathered(df, rows)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wordloom-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)  # its buffers lie in no direct memory
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables there are; a mark for `release`."""
    return len(_written)


def release(since: int, keep: int = 1) -> None:
    """Delete the tables written after the mark `since`, but the last `keep` of them."""
    last = len(_written) - keep
    for entry in _written[since:last]:
        _delete(*entry)
    del _written[since:last]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for entry in _written:
        try:
            _delete(*entry)
        except Exception:  # noqa: BLE001  the session may be gone; the folder's owner cleans up then
            pass

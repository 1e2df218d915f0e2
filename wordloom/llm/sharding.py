"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring of slices; a row belongs to the shard of the first node clockwise
from its key's slice. Loads are bounded by floor or ceiling of rows / shards (law `rows`), and rows that
overflow a full shard continue clockwise to the next shard with room. Balance is thus exact, and one more
shard moves little beside what it takes and what the bounds push on.

Only counts per slice are looked at on the driver (at most SLICES, as many parts again of hot slices, and one for every
PART_ROWS rows): they decide which ranks of which slice go where, so placing rows is one window within slices and one
join with that small plan. A slice with more than HOT times its fair share of rows, or more than PART_ROWS, is split by
row number, so that no window grows with the table.

Cases: null texts count 1 and have the checksum of nothing; null ids share one place on the ring; repeated rows
are rows of their own; fewer rows than shards leave shards empty; an empty table gives no rows; extra columns
pass through, whatever their names, but for shard and slot. DataFrame operations only.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import free
from wordloom.session import gathered, materialise, table

SLICE_BITS = 12
SLICES = 1 << SLICE_BITS
#: A slice with so many times its share of rows is dealt out in parts.
HOT = 4
#: Rows that one window ranks.
PART_ROWS = 2_000_000


def ring(spark, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slice, shard) of all virtual nodes in ring order. A shard's nodes don't depend on how many shards there are."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    place = F.xxhash64(F.lit("node"), F.col("shard").cast("int"), F.col("v").cast("int"))
    rows = nodes.select(place.alias("p"), "shard").collect()
    return [(slice_, shard) for slice_, _, shard in sorted((((r.p >> (64 - SLICE_BITS)) & (SLICES - 1)), r.p, int(r.shard)) for r in rows)]


def plan(counts: Iterable[tuple[int, int, int]], nodes: list[tuple[int, int]], shards: int) -> list[dict]:
    """counts: (slice, part, rows). Chunks of ranks with their shard and first slot. First every owner takes what it has
    room for, in ring order; then what is left over goes on clockwise, a shard further in each round."""
    left = sorted([s, p, 0, n] for s, p, n in counts if n)
    total = sum(x[3] for x in left)
    room = {k: total // shards + (k < total % shards) for k in range(shards)}
    used = dict.fromkeys(range(shards), 0)
    at = [s for s, _ in nodes]
    walk: dict[int, list[int]] = {}
    for s in {x[0] for x in left}:
        k = bisect_left(at, s)
        walk[s] = list(dict.fromkeys(shard for _, shard in nodes[k:] + nodes[:k]))
    out = []
    for step in range(shards):
        for x in left:
            shard = walk[x[0]][step]
            take = min(x[3], room[shard])
            if take:
                out.append({"slice": x[0], "part": x[1], "first": x[2], "past": x[2] + take, "shard": shard, "slot0": used[shard]})
                room[shard] -= take
                used[shard] += take
                x[2] += take
                x[3] -= take
        left = [x for x in left if x[3]]
    return out


def _small(spark, rows: list[dict], schema: str) -> DataFrame:
    """A table out of a bounded list."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def assign(df: DataFrame, key: str, shards: int = 16, vnodes: int = 64, row: str = "__row") -> DataFrame:
    """All columns of df but `row`, which numbers its rows, and shard and slot (gapless from 0 in each shard), which take the
    place of columns of these names. df is read several times: pass a table that is cheap to read."""
    spark = df.sparkSession
    place, slice_, part, parts, rank, of, nth, first, past, to, slot0 = (free(df, c) for c in ("place", "slice", "part", "parts", "rank", "of", "nth", "first", "past", "to", "slot0"))
    x = df.withColumn(place, F.xxhash64(F.lit("key"), F.col(f"`{key}`"))).withColumn(slice_, F.shiftrightunsigned(place, 64 - SLICE_BITS).cast("int"))
    counts = {r[0]: r[1] for r in x.groupBy(slice_).agg(F.count(F.lit(1))).collect()}  # at most SLICES rows
    fair = min(max(64, HOT * sum(counts.values()) // SLICES), PART_ROWS)
    hot = {s: -(-n // fair) for s, n in counts.items() if n > fair}  # at most SLICES / HOT slices with SLICES / HOT * 2 parts, or rows / PART_ROWS more
    if hot:
        split = F.broadcast(_small(spark, [{"slice": s, "parts": n} for s, n in hot.items()], "slice int, parts int").toDF(slice_, parts))
        x = x.join(split, slice_, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(F.col(f"`{row}`")), F.col(parts)), F.lit(0)).cast("int"))
        seen = x.where(F.col(parts).isNotNull()).groupBy(slice_, part).agg(F.count(F.lit(1))).collect()
        every = [tuple(r) for r in seen] + [(s, 0, n) for s, n in counts.items() if s not in hot]
    else:
        x = x.withColumn(part, F.lit(0))
        every = [(s, 0, n) for s, n in counts.items()]
    chunks = F.broadcast(_small(spark, plan(every, ring(spark, shards, vnodes), shards), "slice int, part int, first bigint, past bigint, shard int, slot0 bigint").toDF(of, nth, first, past, to, slot0))
    ranked = x.withColumn(rank, F.row_number().over(W.partitionBy(slice_, part).orderBy(place, F.col(f"`{key}`"), F.col(f"`{row}`"))) - 1)
    held = (F.col(slice_) == F.col(of)) & (F.col(part) == F.col(nth)) & (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(past))
    kept = [F.col(f"`{c}`") for c in df.columns if c != row and c.lower() not in ("shard", "slot")]
    return gathered(ranked.join(chunks, held), sum(counts.values())).select(*kept, F.col(to).alias("shard"), (F.col(slot0) + F.col(rank) - F.col(first)).alias("slot"))


def numbered(df: DataFrame) -> DataFrame:
    """Written to the shared folder with a row number of its own for each row, so that retried tasks see the same."""
    return materialise(df.withColumn("__row", F.monotonically_increasing_id()))


def op7_consistent_ring(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = numbered(docs.withColumn("size", F.coalesce("size", F.lit(1).cast("bigint"))))
    return assign(rows, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Mixing sources to target weights in fixed-length blocks.

Each source's documents form one stream of words in order of a hash of their ids, packed into blocks of BLOCK words.
Every output shard has a fixed number of slots, a block each. A shard's source counts are a multinomial draw: each slot
draws a number below the sum of all sources' slots, and the source whose interval holds it counts one. The draws of all shards
together miss the sources' totals by chance, so they are reconciled: a source drawn too often gives places back, evenly
over its shards, and a permutation deals these places to the sources drawn too rarely. Totals are then exact to the word.

The counts number each source's slots from shard to shard. A slot's number maps to a block through the source's
pseudorandom permutation of block indices, a new one for every pass over the source, and slots meet blocks by index. No
block is taken more often than the passes that the target needs, 3 at most. Inside a shard a permutation orders the slots.

Permutations are swap-or-not networks (Hoang, Morris, Rogaway 2012): exact on any domain size, so nothing is
sorted and no index table is kept. Nothing is random but by hashes, so reruns agree.

Targets: sources in order of code points, null last, weigh 1, 2, 3, repeating; they share the sum of all sizes;
no target is above 3 times its source's size, the excess is shared again by weight.

Cases: null and empty texts have size 0 and are taken 0 times; a source without words has target 0; rows that
repeat an id are documents of their own, ordered by size, then by their place in the input; an empty table gives no rows; a very
long text is many pieces; extra columns are not looked at. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.session import gathered, materialise, table

BLOCK = 256
MOST = 3
ROUNDS = 16
#: Slots of an output shard, and the most shards: beyond, shards get more slots. Sources up to which their list is broadcast.
SHARD_SLOTS, MOST_SHARDS, FEW_SOURCES = 4096, 1 << 16, 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a bucket of a source's stream holds about.
BUCKET_ROWS = 20_000


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, applied to index."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, *seed), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit("bit"), r, F.greatest(x, other), *seed), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("bigint"), swap)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> and target. Sources whose limit binds come first in order of limit / weight; the level of the
    others is what the rest leaves, by weight."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    x = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("most", MOST * F.col("source_size"))
    order = W.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    x = x.withColumn("level", rest / weights).withColumn("level", F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("level")))
    x = x.withColumn("level", F.first("level", ignorenulls=True).over(every))
    return x.select("source", "source_size", F.coalesce(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")), F.col("most").cast("double")).alias("target"))


def _name(source: str = "source") -> Column:
    """Sources as a join key that null has too."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


def slot_totals(targets: DataFrame) -> DataFrame:
    """Per source with words to take: __name, whole blocks, all blocks, whole passes, words of the last pass, slots."""
    t = targets.withColumn("take", F.round("target").cast("bigint")).where("take > 0")
    passes, rest = F.floor(F.col("take") / F.col("source_size")), F.col("take") % F.col("source_size")
    t = t.withColumn("full", F.floor(F.col("source_size") / BLOCK)).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    return t.select(_name().alias("__name"), "source_size", "full", "blocks", passes.alias("passes"), rest.alias("rest"), (passes * F.col("blocks") + F.ceil(rest / BLOCK)).alias("slots"))


def _owners(numbers: DataFrame, column: str, shares: DataFrame, n: int, few: bool) -> DataFrame:
    """numbers with the __name whose interval holds `column` (0 .. n - 1); the intervals are as long as `share`, in order
    of names. Both sides meet by a cell of the number line, of 4,096."""
    width = max(1, n // 4096)
    past = F.sum("share").over(W.orderBy("__name").rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = shares.where("share > 0").select("__name", "share", past.alias("__past")).withColumn("__first", F.col("__past") - F.col("share")).drop("share")
    spans = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__first") / width), F.floor((F.col("__past") - 1) / width))))
    met = numbers.withColumn("__cell", F.floor(F.col(column) / width)).join(F.broadcast(spans) if few else spans.hint("merge"), "__cell")
    return met.where((F.col(column) >= F.col("__first")) & (F.col(column) < F.col("__past"))).drop("__cell", "__first", "__past")


def shard_counts(totals: DataFrame, shards: int | None = None) -> DataFrame:
    """shard, __name, n in the shared folder: how many slots of each output shard a source has. Multinomial draws, reconciled
    to the totals (__name, slots); a shard's counts sum to its slots, a source's to its total."""
    spark = totals.sparkSession
    n, sources = totals.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    few = sources <= FEW_SOURCES
    shards = shards or max(1, min(MOST_SHARDS, -(-n // SHARD_SLOTS)))
    per_shard = max(1, -(-n // shards))
    slots = spark.range(n).select(F.floor(F.col("id") / per_shard).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(n)).alias("draw"))
    drawn = _owners(slots, "draw", totals.select("__name", F.col("slots").alias("share")), n, few).groupBy("shard", "__name").agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy("__name")
    upto, every = F.sum("n").over(own.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)), F.sum("n").over(own)
    x = drawn.join(totals.select("__name", "slots"), "__name").withColumns({"upto": upto, "every": every})
    x = x.withColumn("over", F.greatest(F.col("every") - F.col("slots"), F.lit(0)))
    gone = F.expr("over * upto div every - over * (upto - n) div every")  # rounded along the shards, so the sum is `over`
    rows = min(n, shards * sources)  # of the counts, at most
    held = materialise(x.select("shard", "__name", "n", gone.alias("gone")), rows)
    freed = held.groupBy("shard").agg(F.sum("gone").alias("gone")).where("gone > 0")
    holes = freed.agg(F.sum("gone")).first()[0]
    kept = held.select("shard", "__name", (F.col("n") - F.col("gone")).alias("n"))
    if not holes:
        return materialise(kept.where("n > 0"), rows)
    past = F.sum("gone").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
    places = freed.withColumn("past", past).select("shard", F.explode(F.sequence(F.col("past") - F.col("gone"), F.col("past") - 1)).alias("hole"))
    places = places.select("shard", permuted(F.col("hole"), F.lit(holes), F.lit("fill")).alias("draw"))
    lack = totals.select("__name", "slots").join(held.groupBy("__name").agg(F.sum("n").alias("n")), "__name", "left")
    lack = lack.select("__name", F.greatest(F.col("slots") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("share"))
    filled = _owners(places, "draw", lack, holes, few).groupBy("shard", "__name").agg(F.count(F.lit(1)).alias("n"))
    return materialise(kept.unionByName(filled).groupBy("shard", "__name").agg(F.sum("n").alias("n")).where("n > 0"), rows)


def slots_of(targets: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix: shard, position, __name of the source, pass (from 0), block, words taken of it (all but the last slot of a
    source take whole blocks)."""
    totals = materialise(slot_totals(targets), 1)  # a row per source
    counts = shard_counts(totals, shards)
    before = lambda key, order: F.sum("n").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    s = counts.withColumns({"first": before("__name", "shard"), "place": before("shard", "__name"), "all": F.sum("n").over(W.partitionBy("shard"))})
    s = s.join(totals, "__name").repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "__name")  # by number, for the rows are few until exploded
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    slot = F.col("first") + F.col("k")
    s = s.withColumn("pass", F.floor(slot / F.col("blocks"))).withColumn("index", slot % F.col("blocks"))
    block = F.when(F.col("index") == F.col("full"), F.col("index")).otherwise(permuted(F.col("index"), F.col("full"), F.col("__name"), F.col("pass")))
    length = F.when(F.col("index") == F.col("full"), F.col("source_size") - F.col("full") * BLOCK).otherwise(F.lit(BLOCK).cast("bigint"))
    words = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("index") * BLOCK))
    position = permuted(F.col("place") + F.col("k"), F.col("all"), F.lit("place"), F.col("shard"))
    return s.select("shard", position.alias("position"), "__name", "pass", block.alias("block"), words.alias("words"))


def _along(x: DataFrame, value: str, *cells: str, order: tuple[str, ...]) -> DataFrame:
    """x with __past, the running sum of `value` along each __name in order of cells, then of `order`. Cells are summed
    first, then each is run through, so a hot source is in many tasks."""
    sums = x.groupBy("__name", *cells).agg(F.sum(value).alias("__n"))
    offsets = sums.select("__name", *cells, (F.sum("__n").over(W.partitionBy("__name").orderBy(*cells)) - F.col("__n")).alias("__before"))
    inside = W.partitionBy("__name", *cells).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("__in", F.sum(value).over(inside)).join(offsets, ["__name", *cells])
    return x.withColumn("__past", F.col("__before") + F.col("__in")).drop("__before", "__in")


def _buckets(rows: int) -> Column:
    """Rows of one id are told apart by their sizes, so that many rows without an id are not one bucket."""
    return F.pmod(F.xxhash64("doc_id", "size"), F.lit(max(16, min(1 << 16, -(-rows // BUCKET_ROWS))))).cast("int")


def pieces_of(docs: DataFrame, rows: int) -> DataFrame:
    """Packed blocks: __name, block, the words [lo, hi) of it that a document (doc_id, __row) fills, and the document's word
    at lo; documents without words have a null block. docs: doc_id, source, size, __row."""
    x = docs.select("doc_id", "size", "__row", _name().alias("__name"), F.xxhash64("doc_id", "size").alias("__hash"), _buckets(rows).alias("__bucket"))
    x = _along(x, "size", "__bucket", order=("__hash", "doc_id", "__row"))
    x = x.withColumn("__start", F.col("__past") - F.col("size"))
    covers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("__start") / BLOCK), F.floor((F.col("__past") - 1) / BLOCK)))
    x = x.withColumn("block", F.explode_outer(covers))
    begin = F.col("block") * BLOCK
    lo, hi = F.greatest(F.col("__start") - begin, F.lit(0)), F.least(F.col("__past") - begin, F.lit(BLOCK))
    return x.select("doc_id", "__name", "size", "__row", "block", lo.alias("lo"), hi.alias("hi"), (begin + lo - F.col("__start")).alias("at"))


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size, __row in the shared folder. row: a column that numbers the rows, where there is one."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    return materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), number.alias("__row")))


def _targets(base: DataFrame) -> DataFrame:
    return materialise(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), 1)  # a row per source


def _dealt(base: DataFrame, targets: DataFrame, shards: int | None, how: str) -> DataFrame:
    """Pieces of packed blocks met by the slots that map to them."""
    met = pieces_of(base, base.count()).join(slots_of(targets, shards).hint("merge"), ["__name", "block"], how)  # its size follows the corpus, though it comes of a small table
    return met.withColumn("hi", F.when(F.col("words").isNotNull() & F.col("block").isNotNull(), F.least("hi", "words")))


def takings(base: DataFrame, shards: int | None = None) -> DataFrame:
    """Of every row of `sized` documents: __row, doc_id, __name, size, source_size, target, taken, how many pieces of it
    the mix holds, and the shard and position of the first."""
    targets = _targets(base)
    there = F.col("hi") > F.col("lo")
    n = F.when(there, F.col("hi") - F.col("lo"))
    taken = _dealt(base, targets, shards, "left").groupBy("__row", "doc_id", "__name", "size").agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("taken"),
        F.count_if(there).alias("pieces"),
        F.min(F.when(there, F.struct("shard", "position"))).alias("first"),
    )
    of = targets.select(_name().alias("__name"), "source_size", "target")
    return gathered(taken.join(of, "__name"), base.count()).select("__row", "doc_id", "__name", "size", "source_size", "target", "taken", "pieces", F.col("first.shard").alias("first_shard"), F.col("first.position").alias("first_position"))


def dealt(base: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix of `sized` documents itself: shard, position, doc_id, __row, the words [lo, hi) of the slot's block that
    the document fills there, and the document's word at lo. A document's words in all slots together are its `taken`."""
    return _dealt(base, _targets(base), shards, "inner").where("lo < hi").select("shard", "position", "doc_id", "__row", "lo", "hi", "at")


def packed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix as text: shard, position, doc_ids in order, n_words, text (words joined by blanks) of every slot, BLOCK words
    at most. A document's words are cut once, for all its slots."""
    rows = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("__n")))
    spans = dealt(sized(rows, "__n"), shards).groupBy("__row").agg(F.collect_list(F.struct("shard", "position", "lo", "hi", "at")).alias("spans"))  # as many as a text's blocks, three times
    words = rows.join(spans, F.col("__n") == F.col("__row")).withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = F.explode(F.transform("spans", lambda s: F.struct(s["shard"].alias("shard"), s["position"].alias("position"), F.struct(s["lo"].alias("lo"), F.col("doc_id").alias("doc_id"), F.slice("w", (s["at"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")).alias("w")).alias("piece"))))
    x = words.select(cut.alias("x")).select("x.*").groupBy("shard", "position").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    w = F.flatten("p.w")
    return x.select("shard", "position", F.col("p.doc_id").alias("doc_ids"), F.size(w).cast("bigint").alias("n_words"), F.array_join(w, " ").alias("text"))


def copies_of(base: DataFrame) -> DataFrame:
    """__row, copies: how often each document appears in the mix, whole. The words taken over the size; remainders are cumulated
    along each source in order of size (16 steps an octave) and give one copy more at every whole, so a source's words come
    within about its longest document's length of its target."""
    one, x = 1 << 20, takings(base)
    part = F.expr(f"(taken % size) * {one} div size")
    step = F.floor(F.log2(F.col("size")) * 16).cast("int")
    x = x.where("size > 0").withColumns({"part": part, "__step": step, "__bucket": _buckets(base.count()), "__hash": F.xxhash64("doc_id", "size")})
    x = _along(x, "part", "__step", "__bucket", order=("__hash", "doc_id", "__row"))
    upto = lambda c: F.floor((c + one // 2) / one)
    return x.select("__row", (F.expr("taken div size") + upto(F.col("__past")) - upto(F.col("__past") - F.col("part"))).alias("copies"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = takings(sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "pieces", "first_shard", "first_position")

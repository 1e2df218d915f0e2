"""N-gram Jaccard join by signature trees.

A text's set is its distinct word n-grams. Sets are made comparable in three steps, none of which can lose a link:

1. Equal sets are met by a 128-bit hash and from then on stand for one another.
2. Regions. For a linked pair of sizes a <= b the symmetric difference is at most d = (a + b)(1 - t) / (1 + t). The hash
   space is cut into k > d segments (k by class of size, neighbouring classes sharing one); a differing
   n-gram spoils one segment, so whole segments of both are equal, and in any order of segments the first d + 1 of
   each set's must hold a common one (prefix filter). Empty segments don't count; a set with so many that nothing is
   sure takes a signature shared by all such sets of its class. This is done twice: once in an order that each
   set knows by itself (most n-grams first, then hash), which drops the sets that share nothing, and among what is
   left with the rarest segments first, so that a footer or passage that many texts share brings them together
   only if they have hardly anything else. Sets that share a signature are linked to the smallest of them, and the components
   of that are the regions: all links lie inside regions.
3. Trees. The sets of a region are the leaves of a tree whose nodes hold OR-combined bitmaps of their n-grams, the range
   of sizes and the largest excess of a size over its bitmap's bits. A dual traversal from the root drops pairs of
   nodes whose sizes can't link, whose greatest possible overlap (common bits plus the smaller excess) is below
   what the sizes ask for, or which are all one component already; what is left is verified exactly.

A region over LEAVES sets (or NGRAMS n-grams) is dealt to cells: each part with the region's first set, then, only
if sets remain outside the first one's component, these against the sets that they share a signature with. Copies and near
copies of one text thus cost a linear amount of work.

Cases: null, empty and blank texts have the empty set, link with nothing and are their own component; texts
of fewer words than n are one n-gram; repeated rows and equal texts are one component; an empty table gives no
rows; extra columns, whatever their names, are not looked at; very long texts are one set each. A document's id is its component when null ids meet: nulls are passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import map_rows, worker_state
from wordloom.llm.components import components
from wordloom.session import gathered, materialise, table

LEAVES, NGRAMS = 1024, 2_000_000
FANOUT = 8
#: Rows up to which a list of sets is broadcast to the scan of all; beyond, it is a shuffle join.
BROADCAST_ROWS = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_EDGES = [6]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(_EDGES[-1] * 3 // 2 + 1)
#: The greatest size of each class.
CLASSES = np.array([5, *(x - 1 for x in _EDGES[1:])], np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))



#: Words whose hashes a worker remembers before it forgets them all.
REMEMBERED = 200_000


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams. A-Z fall to a-z; words are cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = worker_state("word hashes", dict)
    if len(known) > REMEMBERED:
        known.clear()
    get = known.get
    hashes = [get(w) for w in words]
    if None in hashes:
        for k, h in enumerate(hashes):
            if h is None:
                hashes[k] = known[words[k]] = xxhash.xxh3_64_intdigest(words[k])
    h = np.array(hashes, np.uint64)
    if len(h) < n:
        return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64) + np.uint64(len(h)))
    x = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        x = x * _M1 + h[k : len(h) - n + 1 + k]
    return np.unique(mix(x))


def set_key(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def differences(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - percent) // (100 + percent)


def segments(grams: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, int | None]]:
    """What a set is met by, for each class of size that it has partners in: d, the hashes of its whole segments with those
    of the d + 1 that have most n-grams first, and the shared signature, where no common segment is sure."""
    n, found = len(grams), []
    most = 100 * n // percent
    if differences(n, most, percent) < 1:
        return found
    own = int(np.searchsorted(CLASSES, n))
    high, values = grams >> np.uint64(32), mix(grams ^ _M1)
    for c in (own, own + 1):
        top = int(CLASSES[c])
        if c > own and most <= CLASSES[own]:
            continue
        d = differences(n, min(most, top), percent)
        k = (5 * (differences(top, top, percent) + 1) + 3) // 4 + 2
        segment = (high * np.uint64(k)) >> np.uint64(32)
        starts = np.concatenate(([0], np.flatnonzero(segment[1:] != segment[:-1]) + 1))
        counts = np.diff(np.concatenate((starts, [n])))
        label = mix(np.add.reduceat(values, starts) + mix(segment[starts] * _M1 + np.uint64(c)))
        order = ((np.uint64(63) - np.minimum(counts, 63).astype(np.uint64)) << np.uint64(58)) | (label >> np.uint64(6))
        if len(label) > d + 1:
            label = label[np.argpartition(order, d)]
        unsure = len(starts) - d < 1  # k - empty - d
        shared = mix(np.array([c], np.uint64) + np.uint64(1 << 60)).view(np.int64)[0]
        found.append((d, label.view(np.int64), int(shared) if unsure else None))
    return found


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set in the order that it knows by itself."""
    made = [np.concatenate((labels[: d + 1], np.array([] if shared is None else [shared], np.int64))) for d, labels, shared in segments(grams, percent)]
    return np.concatenate(made) if made else np.empty(0, np.int64)


# --- the tree -------------------------------------------------------------------------------------


class Tree:
    """Signature tree over sets; leaves in order of their least hashes, so that similar sets are neighbours."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sets, m = percent, sets, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = 256
        while bits < 2 * np.median(self.sizes) and bits < 4096:
            bits *= 2
        maps = np.zeros((m, bits // 8), np.uint8)
        for k, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        excess = self.sizes - np.bitwise_count(maps).sum(axis=1)
        #: By level: bitmaps, least and greatest size, greatest excess. Level 0 are the sets.
        self.levels = [(maps, self.sizes, self.sizes, excess)]
        while len(self.levels[-1][0]) > FANOUT:
            b, lo, hi, x = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(x, at)))
        self.label = np.arange(m)
        self.postings = None

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a set under node i could link with one under node j."""
        maps, lo, hi, excess = self.levels[level]
        p = self.percent
        ok = (100 * hi[i] >= p * lo[j]) & (100 * hi[j] >= p * lo[i])
        at = np.flatnonzero(ok)
        a, b = i[at], j[at]
        overlap = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64) + np.minimum(excess[a], excess[b])
        overlap = np.minimum(overlap, np.minimum(hi[a], hi[b]))
        ok[at] = (100 + p) * overlap >= p * (lo[a] + lo[b])
        return ok

    def uniform(self, level: int) -> np.ndarray:
        """The component of a node's sets if they are all of one, else -1."""
        lo = hi = self.label
        for _ in range(level):
            at = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        return np.where(lo == hi, lo, -1)

    def overlaps(self, x: int, ys: np.ndarray) -> np.ndarray:
        if len(ys) <= 6:
            return np.array([np.isin(self.sets[y], self.sets[x], assume_unique=True).sum() for y in ys])
        if self.postings is None:
            grams, inverse = np.unique(np.concatenate(self.sets), return_inverse=True)
            owner = np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(inverse, kind="stable")
            self.postings = owner[order], np.concatenate(([0], np.cumsum(np.bincount(inverse)))), np.split(inverse, np.cumsum(self.sizes)[:-1])
        owner, starts, ids = self.postings
        mine = ids[x]
        first, count = starts[mine], starts[mine + 1] - starts[mine]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return np.bincount(owner[at], minlength=len(self.sets))[ys]

    def join(self, asked: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links that span the components; asked: only pairs with a set marked there."""
        if asked is not None:
            wanted = [asked]
            while len(wanted) < len(self.levels):
                wanted.append(np.logical_or.reduceat(wanted[-1], np.arange(0, len(wanted[-1]), FANOUT)))
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 1024 and level:
                stack += [(level, i[k : k + 1024], j[k : k + 1024]) for k in range(0, len(i), 1024)][::-1]
                continue
            same = self.uniform(level)
            keep = (same[i] < 0) | (same[i] != same[j])
            if asked is not None:
                keep &= wanted[level][i] | wanted[level][j]
            if level == 0:
                keep &= i != j
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            ok = self.possible(level, i, j)
            i, j = i[ok], j[ok]
            if level == 0:
                yield from self._verify(i, j)
            elif len(i):
                n = len(self.levels[level - 1][0])
                grid = np.arange(FANOUT)
                a = (i[:, None, None] * FANOUT + grid[:, None]) + 0 * grid
                b = (j[:, None, None] * FANOUT + grid) + 0 * grid[:, None]
                a, b = a.ravel(), b.ravel()
                there = (a < n) & (b < n) & (a <= b)
                stack.append((level - 1, a[there], b[there]))

    def _verify(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        at = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else []
        for s, e in zip(at, [*at[1:], len(i)]):
            x, ys = int(i[s]), j[s:e]
            ys = ys[self.label[ys] != self.label[x]]
            if not len(ys):
                continue
            common = self.overlaps(x, ys)
            ys = ys[100 * common >= self.percent * (self.sizes[x] + self.sizes[ys] - common)]
            for y in ys:
                if self.label[y] != self.label[x]:
                    a, b = sorted((int(self.label[x]), int(self.label[y])))
                    self.label[self.label == b] = a
                    yield x, int(y)


def order_of(sets: list[np.ndarray]) -> list[int]:
    return sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), int(sets[k][min(1, len(sets[k]) - 1)]), len(sets[k])))


def _cells(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """members: cell, doc_id, key1, ask. (cell, a, b): spanning links in every cell, nodes by key1. Rows of a cell
    meet in one task, cells are worked through one after another."""
    text = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text"))
    few = members.count() <= BROADCAST_ROWS
    side = F.broadcast(members) if few else members
    rows = text.join(side, F.col("__id") == F.col("doc_id")).select("cell", "key1", "ask", "text")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "key1")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            sets = [held[k][0] for k in keys]
            order = order_of(sets)
            keys, sets = [keys[k] for k in order], [sets[k] for k in order]
            asked = np.array([held[k][1] for k in keys])
            links = list(Tree(sets, percent).join(None if asked.all() else asked))
            return pa.RecordBatch.from_arrays([pa.array([now] * len(links), pa.int64()), pa.array([keys[x] for x, _ in links], pa.int64()), pa.array([keys[y] for _, y in links], pa.int64())], names=["cell", "a", "b"])

        for batch in batches:
            for cell, key, ask, text in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now:
                    if len(held) > 1:
                        yield out()
                    now, held = cell, {}
                if key not in held:
                    grams = ngrams(text, n)
                    if len(grams) and set_key(grams)[0] == key:  # of several texts under one id, the one meant
                        held[key] = grams, ask
                elif ask and not held[key][1]:
                    held[key] = held[key][0], True
        if len(held) > 1:
            yield out()

    return rows.mapInArrow(run, "cell bigint, a bigint, b bigint")


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key1, key2 of every document, and by class of size (0: its own, 1: the next) d, segments,
    shared, in the shared folder. A set that a worker has just seen leaves its segments out."""
    recent: set[int] = set()

    def run(x: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_shingles", "key1", "key2", "d0", "s0", "c0", "d1", "s1", "c1")}
        for text in x["text"]:
            grams = ngrams(text, n)
            a, b = set_key(grams) if len(grams) else (None, None)
            row: list = [len(grams), a, b]
            if a is not None and a not in recent:
                if len(recent) > 200_000:
                    recent.clear()
                recent.add(a)
                for found in segments(grams, percent):
                    row += found
            for c, v in zip(out, row + [None] * (9 - len(row))):
                out[c].append(v)
        return out | {"doc_id": x["doc_id"]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, n_shingles bigint, key1 bigint, key2 bigint, d0 int, s0 array<bigint>, c0 bigint, d1 int, s1 array<bigint>, c1 bigint"
    return materialise(map_rows(rows, schema, run, ["doc_id", "text"]))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) for every row of docs (doc_id, text)."""
    seen = described(docs, n, percent)
    rows = seen.count()
    reps = materialise(seen.where("key1 is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), rows)
    marks = rarest(seen)
    regions = _regions(marks, rows)
    # sets that lie in a region; small regions are joined in one cell, larger ones are dealt to several
    members = materialise(reps.join(regions, "key1").select("region", "key1", F.col("rep").alias("doc_id"), "n"), rows)
    weights = members.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("sets") / LEAVES), F.ceil(F.col("grams") / NGRAMS))
    weights = weights.where("sets > 1").withColumn("parts", parts)
    dealt = materialise(members.join(weights.select("region", "parts"), "region"), members.count())
    whole = dealt.where("parts = 1").select(F.col("region").alias("cell"), "doc_id", "key1", F.lit(True).alias("ask"))
    links = materialise(_cells(whole, docs, n, percent).select("a", "b"))
    large = dealt.where("parts > 1")
    if large.limit(1).count():
        links = materialise(links.unionByName(_large(large, marks, docs, n, percent)))
    found = components(links, links.count())
    names = reps.join(found, F.col("key1") == F.col("node"), "left").select("key1", "key2", "rep", F.coalesce("component", "key1").alias("c"))
    least = names.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = materialise(names.join(least, "c").select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "component_id"), rows)
    out = seen.join(named, (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left")
    return gathered(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), rows)


def rarest(seen: DataFrame) -> DataFrame:
    """key1, s: the signatures that bring sets together, in the shared folder. Every pair of linked sets shares one."""
    x = seen.where("s0 is not null")
    first = lambda k: F.concat(F.slice(f"s{k}", 1, F.col(f"d{k}") + 1), F.when(F.col(f"c{k}").isNotNull(), F.array(f"c{k}")).otherwise(F.array().cast("array<bigint>")))
    own = x.select("key1", F.explode(F.concat(first(0), F.coalesce(first(1), F.array().cast("array<bigint>")))).alias("s"))
    # a hot signature is counted in each task first, and in the join AQE splits its rows; equal sets seen by several workers
    # count too, and go when each set is there once
    shared = own.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("s")
    met = materialise(own.join(shared.hint("merge"), "s", "left_semi").select("key1").distinct())
    n = met.count()
    met = met.coalesce(max(1, min(met.rdd.getNumPartitions(), -(-n // 10_000))))
    sets = materialise(x.join(F.broadcast(met) if n <= BROADCAST_ROWS else met, "key1", "left_semi").dropDuplicates(["key1"]).select("key1", "d0", "s0", "c0", "d1", "s1", "c1"))
    by_class = sets.select("key1", F.lit(0).alias("k"), F.col("d0").alias("d"), F.explode("s0").alias("s")).unionByName(sets.where("s1 is not null").select("key1", F.lit(1).alias("k"), F.col("d1").alias("d"), F.explode("s1").alias("s")))
    counted = by_class.join(by_class.groupBy("s").agg(F.count(F.lit(1)).alias("sets")).hint("merge"), "s")
    place = F.row_number().over(W.partitionBy("key1", "k").orderBy("sets", "s"))  # a set's segments
    found = counted.withColumn("place", place).where((F.col("place") <= F.col("d") + 1) & (F.col("sets") > 1)).select("key1", "s")
    unsure = sets.where("c0 is not null").select("key1", F.col("c0").alias("s")).unionByName(sets.where("c1 is not null").select("key1", F.col("c1").alias("s")))
    return materialise(found.unionByName(unsure))


def _regions(marks: DataFrame, rows: int) -> DataFrame:
    """key1, region of sets that share a signature with another set, directly or through others."""
    least = marks.groupBy("s").agg(F.min("key1").alias("a"))
    links = marks.join(least.hint("merge"), "s").where("a < key1").select("a", F.col("key1").alias("b"))
    found = components(links, rows)
    return found.select(F.col("node").alias("key1"), F.col("component").alias("region")).unionByName(found.select("component", F.col("component").alias("region")).distinct().toDF("key1", "region"))


def _large(large: DataFrame, marks: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of regions that are dealt to cells."""
    part = F.pmod(F.xxhash64("key1"), F.col("parts")).cast("int")
    x = large.withColumn("part", part)
    first = x.groupBy("region").agg(F.min_by(F.struct("key1", "doc_id"), "key1").alias("f"), F.first("parts").alias("parts"))
    everywhere = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    cell = lambda *c: F.xxhash64(F.lit("cell"), *c)
    own = x.select(cell("region", "part").alias("cell"), "doc_id", "key1", F.lit(True).alias("ask"))
    pivots = everywhere.select(cell("region", "part").alias("cell"), F.col("f.doc_id").alias("doc_id"), F.col("f.key1").alias("key1"), F.lit(True).alias("ask"))
    links = materialise(_cells(materialise(own.unionByName(pivots).distinct()), docs, n, percent).select("a", "b"))
    found = components(links)
    known = x.join(found, F.col("key1") == F.col("node"), "left").select("region", "n", "key1", "doc_id", F.coalesce("component", "key1").alias("c"))
    main = first.join(found, F.col("f.key1") == F.col("node"), "left").select(F.col("region").alias("r"), F.coalesce("component", "f.key1").alias("main"))
    known = materialise(known.join(main, F.col("region") == F.col("r")).withColumn("out", F.col("c") != F.col("main")).drop("r"))
    if not known.where("out").limit(1).count():
        return links
    # what lies outside the first set's component against all that share a signature with it, signature by signature
    met = marks.join(known.withColumnRenamed("key1", "key"), F.col("key1") == F.col("key")).select("s", "key1", "doc_id", "n", "c", "out")
    size = lambda sets, grams: F.greatest(F.ceil(sets / LEAVES), F.ceil(grams / NGRAMS)).cast("int")
    strays = F.when(F.col("out"), F.col("n"))
    by = met.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), size(F.count_if("out"), F.sum(strays)).alias("groups"), size(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    by = materialise(by.where("lo < hi and groups > 0").select("s", "groups", "parts"))
    met = materialise(met.join(by, "s"))
    group, part = F.pmod(F.xxhash64("key1", F.lit(1)), F.col("groups")).cast("int"), F.pmod(F.xxhash64("key1"), F.col("parts")).cast("int")
    askers = met.where("out").withColumn("g", group).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = met.withColumn("p", part).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = askers.select(cell("s", "g", "p").alias("cell"), "doc_id", "key1", F.lit(True).alias("ask")).unionByName(others.select(cell("s", "g", "p").alias("cell"), "doc_id", "key1", F.lit(False).alias("ask")))
    rows = rows.groupBy("cell", "doc_id", "key1").agg(F.max("ask").alias("ask"))
    return links.unionByName(_cells(materialise(rows), docs, n, percent).select("a", "b"))


def op9_signature_tree_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

"""Approximate nearest neighbours by balanced posting lists (Chen et al. 2021, SPANN).

On a sample of at most SAMPLE vectors and SAMPLE_BYTES (first by a hash of their ids), balanced bisection followed by Lloyd rounds
that charge for full lists gives the centroids; each points to near and to random others, and a best-first
search over that graph finds a query's nearest centroids in memory. Every vector is put in its nearest list
and, near a boundary, in up to REPLICAS - 1 more: those not over CLOSURE times as far, unless a list that it
already has lies nearer to that centroid than the vector does. A query reads the lists at most so many times as far as
its nearest one, and so many at most, as the sample's own neighbours ask for (`Index.calibrated`; LEAST_PROBES lists and
LEAST_RATIO are always allowed): few where vectors lie in clusters, many where they lie alike in all directions. A
query that finds fewer than k other ids there is answered again over all lists.

Equal vectors are one entry with their k + 1 smallest ids, enough for any answer. A list expected to hold over
LIST_ROWS entries, or to be asked by over QUERY_ROWS queries, is dealt to cells; a cell's entries are read
first, then queries stream by, so more of them go to a cell: each further share of a list's queries copies its entries. Scores are computed in double precision on the original vectors. What is
broadcast (centroids and graph) is bounded by MOST_LISTS.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; each number of
dimensions is a space of its own; repeated rows of one id and vector are one candidate; a repeated query id with
other vectors answers for all of them together; with no other row a query gets no answer; ties go to the smaller
id; extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import map_rows
from wordloom.session import materialise, table

SAMPLE, SAMPLE_BYTES, LIST_SHARE, MOST_LISTS = 20_000, 128 << 20, 100, 4096
REPLICAS, CLOSURE, LIST_ROWS, QUERY_ROWS = 4, 1.3, 2048, 32768
#: The share of the sample's true neighbours that reading must find, of so many queries; the least lists and ratio read.
FOUND, ASKED, LEAST_PROBES, LEAST_RATIO = 0.97, 256, 64, 1.4
NEAR, FAR = 12, 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """Centroids on the unit sphere, their graph, and how full and how often asked each list is in the sample."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 1):
        x, r = unit(sample), np.random.default_rng(seed)
        lists = max(1, min(MOST_LISTS, total // LIST_SHARE, max(1, len(x) // 4)))
        groups = [np.arange(len(x))]
        while len(groups) < lists:  # halve the largest by its main direction
            k = max(range(len(groups)), key=lambda g: len(groups[g]))
            own = groups.pop(k)
            axis = x[own[r.integers(len(own))]] - x[own[r.integers(len(own))]]
            for _ in range(3):
                side = x[own] @ axis
                axis = x[own][side > np.median(side)].sum(axis=0) - x[own][side <= np.median(side)].sum(axis=0)
            order = np.argsort(x[own] @ axis, kind="stable")
            groups += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        c = np.stack([x[g].mean(axis=0) for g in groups])
        load = np.array([len(g) for g in groups], np.float64)
        for _ in range(4):
            c = c / np.maximum(1e-12, np.sqrt((c * c).sum(axis=1, keepdims=True)))
            near = np.argmax(x @ c.T - 0.02 * load / load.mean(), axis=1)
            load = 0.5 * load + 0.5 * np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, sums, c)
        self.centroids = (c / np.maximum(1e-12, np.sqrt((c * c).sum(axis=1, keepdims=True)))).astype(np.float32)
        sims = self.centroids @ self.centroids.T
        np.fill_diagonal(sims, -2)
        near = np.argsort(-sims, axis=1, kind="stable")[:, : min(NEAR, max(1, lists - 1))]
        self.graph = np.concatenate((near, r.integers(0, lists, (lists, FAR))), axis=1)
        self.entries = np.unique(np.linspace(0, lists - 1, min(8, lists)).astype(int))
        held = self.homes(sample)
        count, ratio = self.calibrated(sample, held)
        self.probes, self.ratio = min(lists, max(LEAST_PROBES, count)), max(LEAST_RATIO, ratio)
        few = sample[:: max(1, len(sample) // 4000)]
        self.share = np.bincount(np.concatenate(held), minlength=lists) / len(sample)
        self.asked = np.bincount(np.concatenate(self.search(few)), minlength=lists) / len(few)
        self.stamp = uuid.uuid4().hex

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each vector."""
        out: list[np.ndarray] = []
        for at in range(0, len(x), 2048):
            sims = unit(x[at : at + 2048]).astype(np.float32) @ self.centroids.T
            take = min(len(self.centroids), 4 * REPLICAS)
            top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            for row, ids in zip(sims, top):
                ids = ids[np.argsort(-row[ids], kind="stable")]
                far = np.sqrt(np.maximum(0, 2 - 2 * row[ids]))
                held = [int(ids[0])]
                for c, d in zip(ids[1:].tolist(), far[1:].tolist()):
                    if len(held) == REPLICAS or d > CLOSURE * far[0]:
                        break
                    if (2 - 2 * (self.centroids[held] @ self.centroids[c]) > d * d * 0.25).all():
                        held.append(c)
                out.append(np.array(held))
        return out

    def calibrated(self, sample: np.ndarray, held: list[np.ndarray], k: int = 5) -> tuple[int, float]:
        """How many lists, and lists of what distance ratio, hold the share FOUND of the sample's own k nearest of ASKED of its
        vectors. In all rows the nearest lie closer than in a sample of them, so this is on the safe side."""
        asked = np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)
        if len(sample) <= 1:
            return 1, 1.0
        x = unit(sample).astype(np.float32)
        counts, ratios = [], []
        for at in range(0, len(asked), 64):
            own = asked[at : at + 64]
            sims = x[own] @ x.T
            sims[np.arange(len(own)), own] = -3
            near = np.argpartition(-sims, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
            lists = x[own] @ self.centroids.T
            order = np.argsort(np.argsort(-lists, axis=1, kind="stable"), axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * lists))
            for r, row in enumerate(near):
                counts += [order[r, held[v]].min() + 1 for v in row]
                ratios += [far[r, held[v]].min() / max(float(far[r].min()), 1e-6) for v in row]
        return int(np.quantile(counts, FOUND, method="higher")), float(np.quantile(ratios, (1 + FOUND) / 2, method="higher"))

    def search(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each query reads: best-first over the graph, all queries of a block in step. A query keeps the
        nearest centroids it has met, a quarter more than it may read, and a mark for each that it has seen."""
        out: list[np.ndarray] = []
        n = len(self.centroids)
        width, block = min(n, self.probes + self.probes // 4), max(16, 16384 // x.shape[1])
        for at in range(0, len(x), block):
            q = unit(x[at : at + block]).astype(np.float32)
            rows = np.arange(len(q))[:, None]
            seen = np.zeros((len(q), n), bool)
            seen[:, self.entries] = True
            ids = np.tile(self.entries, (len(q), 1))
            scores = q @ self.centroids[self.entries].T
            open_ = np.ones(ids.shape, bool)
            while True:
                ready = np.where(open_, scores, -3)
                step = min(8, ids.shape[1])
                best = np.argpartition(-ready, step - 1, axis=1)[:, :step]
                live = ready[rows, best] > -3
                if not live.any():
                    break
                open_[rows, best] = False
                near = self.graph[ids[rows, best]].reshape(len(q), -1)
                near = np.sort(np.where(np.repeat(live, self.graph.shape[1], axis=1) & ~seen[rows, near], near, n), axis=1)
                new = near < n
                new[:, 1:] &= near[:, 1:] != near[:, :-1]
                a, b = np.nonzero(new)
                found = near[a, b]
                seen[a, found] = True
                met = np.full(near.shape, -3, np.float32)
                met[a, b] = np.einsum("ij,ij->i", q[a], self.centroids[found])
                ids, scores, open_ = np.hstack((ids, np.where(new, near, 0))), np.hstack((scores, met)), np.hstack((open_, new))
                if ids.shape[1] > width:
                    top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                    ids, scores, open_ = ids[rows, top], scores[rows, top], open_[rows, top]
            for own, row in zip(ids, scores):
                order = np.argsort(-row, kind="stable")[: self.probes]
                far = np.sqrt(np.maximum(0, 2 - 2 * row[order]))
                out.append(own[order][(far <= self.ratio * far[0] + 1e-6) & (row[order] > -2)])
        return out


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """rows, queries: id (bigint), vector (array<double> or <float>). query_id, rank, vec_id, score."""
    rows, queries = (x.select(F.col("id").cast("bigint").alias("id"), "vector").where(F.col("id").isNotNull() & usable(F.col("vector"))) for x in (rows, queries))
    sizes = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())  # dimensions in use: a handful

    def answers(asked: DataFrame, everywhere: bool) -> DataFrame | None:
        found = None
        for d in sizes:
            one = _nearest(rows.where(F.size("vector") == d), asked.where(F.size("vector") == d), d, k, everywhere)
            found = one if found is None else found.unionByName(one)
        return found

    found = answers(queries, False)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = materialise(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = materialise(queries.join(full, F.col("id") == F.col("query_id"), "left_anti"))
    if short.limit(1).count():
        best = best.unionByName(answers(short, True)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, queries: DataFrame, dim: int, k: int, everywhere: bool) -> DataFrame:
    mark = F.xxhash64("vector")
    few = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy(mark, "vector").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = materialise(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    total = entries.count()
    sample = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("vector").toArrow()
    index = Index(_stack(sample.column(0).combine_chunks()), total)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(index)
    parts = {c: int(-(-s * total // LIST_ROWS)) or 1 for c, s in enumerate(index.share)}
    asked = queries.count()
    turns = {c: int(-(-(1 if everywhere else s) * asked // QUERY_ROWS)) or 1 for c, s in enumerate(index.asked)}

    def cells_of(ids: list[int], lists: list[np.ndarray], split: dict, every: dict, queries_: bool) -> list[list[int]]:
        """An entry lies in one part of each list, for all its turns; a query takes one turn, in all parts."""
        out = []
        for i, own in zip(ids, lists):
            spread = (i * 2654435761 >> 7) & 0xFFFFFF
            cells = []
            for c in own.tolist():
                mine = spread % split[c]
                cells += [(c << 40) | ((p << 20) | mine if queries_ else (mine << 20) | p) for p in range(every[c])]
            out.append(cells)
        return out

    def place_entries(x: dict) -> dict:
        return {"cells": cells_of([i[0] for i in x["ids"]], shared.value.homes(_stack(x["vector"])), parts, turns, False), "id": [None] * len(x["ids"]), "ids": x["ids"], "vector": x["vector"]}

    def place_queries(x: dict) -> dict:
        lists = [np.arange(len(shared.value.centroids))] * len(x["id"]) if everywhere else shared.value.search(_stack(x["vector"]))
        return {"cells": cells_of(x["id"], lists, turns, parts, True), "id": x["id"], "ids": [None] * len(x["id"]), "vector": x["vector"]}

    kind = rows.schema["vector"].dataType.simpleString()
    schema = f"cells array<bigint>, id bigint, ids array<bigint>, vector {kind}"
    left = map_rows(entries, schema, place_entries, ["ids", "vector"], passing=("vector",))
    right = map_rows(queries.distinct(), schema, place_queries, ["id", "vector"], passing=("vector",))
    dealt = left.unionByName(right).withColumn("cell", F.explode("cells")).drop("cells")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", F.col("id").asc_nulls_first()).select("cell", "id", "ids", "vector")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, units = None, [], None
        for batch in batches:
            cell, ids = batch.column(0).to_numpy(), batch.column(1)
            is_query = np.array([v is not None for v in ids.to_pylist()])
            vectors, known = _stack(batch.column(3)).astype(np.float64), batch.column(2)
            out: list[tuple] = []
            edges = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (is_query[1:] != is_query[:-1]), [True])))
            for s, e in zip(edges[:-1], edges[1:]):
                if cell[s] != now:
                    now, held, units = cell[s], [], None
                if not is_query[s]:
                    held.append((vectors[s:e], known.slice(s, e - s).to_pylist()))
                elif held:
                    if units is None:
                        stack = np.concatenate([v for v, _ in held])
                        units = stack, unit(stack), np.sqrt((stack * stack).sum(axis=1)), [i for _, x in held for i in x]
                    out += _best(vectors[s:e], ids.slice(s, e - s).to_pylist(), units, k)
            if out:
                q, i, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.float64())], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _best(q: np.ndarray, ids: list[int], units: tuple, k: int) -> list[tuple[int, int, float]]:
    """The k nearest ids of each query among a cell's entries: a product of unit vectors selects, the measure itself
    decides, a row at a time, so equal vectors score equally wherever they lie."""
    raw, normed, lengths, known = units
    out = []
    take = min(len(raw), k + 1)
    for at in range(0, len(q), 512):
        block = q[at : at + 512]
        sims = unit(block) @ normed.T
        cut = np.partition(sims, len(raw) - take, axis=1)[:, len(raw) - take] - 1e-9
        own = np.sqrt((block * block).sum(axis=1))
        for i in range(len(block)):
            near = np.flatnonzero(sims[i] >= cut[i])
            score = (raw[near] * block[i]).sum(axis=1) / (lengths[near] * own[i])
            best = sorted(zip((-score).tolist(), (known[j][0] for j in near), near.tolist()))[: k + 1]
            ranked = sorted((s, v) for s, _, j in best for v in known[j] if v != ids[at + i])[:k]
            out += [(ids[at + i], v, -s) for s, v in ranked]
    return out


def op10_balanced_lists(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, rows.where(F.col("id") % 50 == 0))

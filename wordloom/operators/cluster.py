"""Reducing and clustering descriptors: unit vectors, an optional projection, density clusters of the hierarchy's
leaves, noise dropped, labels without gaps.

Groups of up to MOST_POINTS points are clustered in one task each. Above that the exact nearest neighbours are found by
blocks in all tasks, the spanning tree of a group grows from them in Boruvka rounds, and the driver holds its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.arrow import matrix, squared, unit_rows, with_columns
from wordloom.functions.vectors import wide
from wordloom.session import materialise

#: Points that one task clusters.
MOST_POINTS = 20_000
#: Bytes of vectors that are broadcast at a time, and rows that a task compares with them at a time.
CHUNK_BYTES, ROWS = 32 << 20, 128
#: Bytes of the sample that a layout is fitted on.
SAMPLE_BYTES = 64 << 20


def spanning_edges(x: np.ndarray, min_samples: int = 1) -> np.ndarray:
    """Edges (a, b, distance) of the minimum spanning tree under mutual reachability, by Prim's rule a row at a time."""
    n = len(x)
    core = np.zeros(n)
    if min_samples > 1:
        for k in range(n):
            d = np.sqrt(np.maximum(0, ((x - x[k]) ** 2).sum(axis=1)))
            core[k] = np.partition(d, min(min_samples, n - 1))[min(min_samples, n - 1)]
    done, best, via = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, np.int64)
    at, out = 0, np.empty((max(0, n - 1), 3))
    for k in range(n - 1):
        done[at] = True
        d = np.sqrt(np.maximum(0, ((x - x[at]) ** 2).sum(axis=1)))
        d = np.maximum(np.maximum(d, core), core[at])
        closer = ~done & (d < best)
        best[closer], via[closer] = d[closer], at
        best[done] = np.inf
        new = int(np.argmin(best))
        out[k] = via[new], new, best[new]
        at = new
    return out


def leaf_clusters(x: np.ndarray, min_cluster_size: int = 5, min_samples: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and membership strengths of the condensed hierarchy's leaves (Campello, Moulavi, Sander 2013)."""
    if len(x) < max(2, min_cluster_size):
        return np.full(len(x), -1, np.int64), np.zeros(len(x))
    return leaves_of(spanning_edges(x, min_samples), min_cluster_size)


def leaves_of(edges: np.ndarray, min_cluster_size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the edges of a spanning tree."""
    n = len(edges) + 1
    labels, prob = np.full(n, -1, np.int64), np.zeros(n)
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    parent, size = np.arange(2 * n - 1), np.concatenate((np.ones(n, np.int64), np.zeros(n - 1, np.int64)))
    kids, dist = np.zeros((n - 1, 2), np.int64), edges[:, 2]

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k, (a, b, _) in enumerate(edges):
        ra, rb = root(int(a)), root(int(b))
        kids[k], size[n + k] = (ra, rb), size[ra] + size[rb]
        parent[ra] = parent[rb] = n + k

    def points(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v - n].tolist()
        return out

    # walk down: a cluster lives while only one side is large enough; two large sides are two new clusters
    leaves, stack = [], [2 * n - 2]
    while stack:
        node, gone = stack.pop(), []
        while True:
            if node < n:
                gone.append((node, np.inf))
                leaves.append(gone)
                break
            a, b = kids[node - n].tolist()
            level = 1.0 / dist[node - n] if dist[node - n] > 0 else np.inf
            big = [v for v in (a, b) if size[v] >= min_cluster_size]
            if len(big) == 2:
                stack += [b, a]
                break
            if not big:
                gone += [(p, level) for p in points(node)]
                leaves.append(gone)
                break
            small = b if big[0] == a else a
            gone += [(p, level) for p in points(small)]
            node = big[0]
    if len(leaves) == 1:
        return labels, prob  # one cluster is the root itself, which isn't chosen
    for label, gone in enumerate(sorted(leaves, key=lambda g: min(p for p, _ in g))):
        finite = [v for _, v in gone if np.isfinite(v)]
        top = max(finite) if finite else np.inf
        for p, v in gone:
            labels[p], prob[p] = label, 1.0 if not np.isfinite(v) or not np.isfinite(top) else min(v, top) / top
    return labels, prob


def numbered(x: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """x with __i, 0 .. n - 1 in the given order, in the shared folder, and n. Rows are numbered within partitions."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    y = materialise(x.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__row": row}))
    before, n = [], 0
    for part, rows in sorted((r["__part"], r["count"]) for r in y.groupBy("__part").count().collect()):
        before += [F.lit(part), F.lit(n).cast("bigint")]
        n += rows
    return y.withColumn("__i", F.create_map(*before)[F.col("__part")] + F.col("__row")).drop("__part", "__row"), n


def _chunks(points: DataFrame, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors in order, CHUNK_BYTES of them at a time, and the number of the first."""

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"i": [pdf["__i"].to_numpy(np.int64).tobytes()], "x": [np.stack(pdf["vec"].to_numpy()).tobytes()]})

    dim = len(points.select("vec").first()["vec"])
    step = max(1, CHUNK_BYTES // (8 * max(1, dim)))
    for first in range(0, n, step):
        x = np.empty((min(step, n - first), dim))
        for r in points.where(F.col("__i").between(first, first + step - 1)).select("__i", "vec").mapInPandas(pack, "i binary, x binary").collect():
            x[np.frombuffer(r["i"], np.int64) - first] = np.frombuffer(r["x"]).reshape(-1, dim)
        yield first, x


def _compared(points: DataFrame, chunk: np.ndarray, work, columns: dict[str, type], wanted: np.ndarray | None = None) -> Iterator[list[np.ndarray]]:
    """work(numbers, vectors, squared distances to the chunk, their error at most, chunk) of ROWS points at a time, in all tasks."""
    spark = points.sparkSession
    sent, chosen = spark.sparkContext.broadcast(chunk), spark.sparkContext.broadcast(wanted)

    def run(batches):
        b, chosen_ = sent.value, chosen.value
        norms = (b * b).sum(axis=1)
        for pdf in batches:
            if not len(pdf):
                continue
            ids, a = pdf["__i"].to_numpy(np.int64), np.stack(pdf["vec"].to_numpy())
            if chosen_ is not None:
                ids, a = ids[chosen_[ids]], a[chosen_[ids]]
            for at in range(0, len(a), ROWS):
                own = a[at : at + ROWS]
                mine = (own * own).sum(axis=1)
                d = own @ b.T
                d *= -2
                d += norms
                d += mine[:, None]
                error = 16 * a.shape[1] * np.finfo(float).eps * (mine + norms.max())
                got = work(ids[at : at + ROWS], own, d, error, b)
                yield pd.DataFrame({c: [np.ascontiguousarray(v, t).tobytes()] for (c, t), v in zip(columns.items(), got)})

    spread = points.select("__i", "vec").repartition(4 * spark.sparkContext.defaultParallelism)
    for r in spread.mapInPandas(run, ", ".join(f"{c} binary" for c in columns)).collect():
        yield [np.frombuffer(r[c], t) for c, t in columns.items()]
    sent.unpersist()
    chosen.unpersist()


def nearest(points: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and distances of the k nearest other points of every point, nearest first, and a distance below which no
    point is missing."""
    near, dist, bound = np.zeros((n, k), np.int64), np.full((n, k), np.inf), np.full(n, np.inf)
    for first, chunk in _chunks(points, n):

        def work(ids, own, d, error, b, first=first):
            here = (ids >= first) & (ids < first + len(b))
            d[np.flatnonzero(here), ids[here] - first] = np.inf
            m = min(k, len(b))
            top = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(b) else np.tile(np.arange(m), (len(d), 1))
            rough = np.take_along_axis(d, top, axis=1)
            low = np.sqrt(np.maximum(0, rough.max(axis=1) - error)) if m < len(b) else np.full(len(d), np.inf)
            exact = np.where(np.isfinite(rough), np.sqrt(((own[:, None] - b[top]) ** 2).sum(axis=2)), np.inf)
            return ids, np.pad(top + first, ((0, 0), (0, k - m))), np.pad(exact, ((0, 0), (0, k - m)), constant_values=np.inf), low

        for ids, top, exact, low in _compared(points, chunk, work, {"i": np.int64, "near": np.int64, "dist": np.float64, "low": np.float64}):
            a, b = np.hstack((near[ids], top.reshape(-1, k))), np.hstack((dist[ids], exact.reshape(-1, k)))
            order = np.argsort(b, axis=1, kind="stable")[:, :k]
            near[ids], dist[ids] = np.take_along_axis(a, order, axis=1), np.take_along_axis(b, order, axis=1)
            bound[ids] = np.minimum(np.minimum(bound[ids], low), dist[ids, -1])
    return near, dist, bound


def _outside(points: DataFrame, n: int, wanted: np.ndarray, group: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the wanted points: the least mutual reachability to a point of another group, and that point."""
    w, to = np.full(n, np.inf), np.zeros(n, np.int64)
    sent = points.sparkSession.sparkContext.broadcast((group, core))
    for first, chunk in _chunks(points, n):

        def work(ids, own, d, error, b, first=first):
            group_, core_ = sent.value
            far = core_[first : first + len(b)]
            np.maximum(d, far * far, out=d)
            d[group_[ids][:, None] == group_[first : first + len(b)]] = np.inf
            found, at = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
            low = np.maximum(d.min(axis=1), core_[ids] ** 2)
            for r in np.flatnonzero(np.isfinite(low)):
                near = np.flatnonzero(d[r] <= low[r] + 2 * error[r])
                exact = np.maximum(np.maximum(np.sqrt(((own[r] - b[near]) ** 2).sum(axis=1)), far[near]), core_[ids[r]])
                found[r], at[r] = exact.min(), near[exact.argmin()] + first
            return ids, found, at

        for ids, found, at in _compared(points, chunk, work, {"i": np.int64, "w": np.float64, "to": np.int64}, wanted):
            less = found < w[ids]
            w[ids[less]], to[ids[less]] = found[less], at[less]
    sent.unpersist()
    return w, to


def spanning_edges_of(points: DataFrame, n: int, min_samples: int = 1) -> np.ndarray:
    """spanning_edges of a numbered table, by Boruvka's rounds: every group but the largest takes its shortest edge to
    another one. Neighbour lists tell most of them; points whose list ends too early are compared with all others."""
    near, dist, bound = nearest(points, n, min(n - 1, max(16, min_samples + 8)))
    core = dist[:, min(min_samples, n - 1) - 1].copy() if min_samples > 1 else np.zeros(n)
    reach = np.maximum(np.maximum(dist, core[near]), core[:, None])
    group, every, out = np.arange(n), np.arange(n), []
    while True:
        names, group = np.unique(group, return_inverse=True)
        if len(names) == 1:
            return np.array(out, float).reshape(-1, 3)
        largest = np.bincount(group).argmax()
        away = np.where(group[near] != group[:, None], reach, np.inf)
        place = away.argmin(axis=1)
        w, to = away[every, place], near[every, place]
        best = np.full(len(names), np.inf)
        np.minimum.at(best, group, w)
        wanted = (group != largest) & (w > bound) & (bound < best[group])
        if wanted.any():
            more, there = _outside(points, n, wanted, group, core)
            w, to = np.where(more < w, more, w), np.where(more < w, there, to)
        rows = np.flatnonzero((group != largest) & np.isfinite(w))
        low, high = np.minimum(every, to), np.maximum(every, to)
        rows = rows[np.lexsort((high[rows], low[rows], w[rows]))]
        chosen = np.sort(np.unique(group[rows], return_index=True)[1])
        parent = list(range(len(names)))

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        for i in rows[chosen].tolist():
            a, b = root(int(group[i])), root(int(group[to[i]]))
            if a != b:
                parent[a] = b
                out.append((i, to[i], w[i]))
        group = np.array([root(g) for g in range(len(names))])[group]


def fuzzy_weights(dist: np.ndarray) -> np.ndarray:
    """Weights of each row's neighbours: 1 for the nearest, falling off at the width at which they sum to log2 of their number."""
    rho, k = dist.min(axis=1), dist.shape[1]
    low, high = np.zeros(len(dist)), np.full(len(dist), 1e3)
    for _ in range(40):
        sigma = (low + high) / 2
        more = np.exp(-np.maximum(0, dist - rho[:, None]) / np.maximum(sigma, 1e-9)[:, None]).sum(axis=1) > np.log2(max(2, k))
        high, low = np.where(more, sigma, high), np.where(more, low, sigma)
    return np.exp(-np.maximum(0, dist - rho[:, None]) / np.maximum((low + high) / 2, 1e-9)[:, None])


def umap(x: np.ndarray, dim: int = 10, neighbours: int = 15, min_dist: float = 0.0, epochs: int = 200, seed: int = 42) -> np.ndarray:
    """Uniform manifold approximation (McInnes, Healy, Melville 2018) of the rows of x: exact neighbours, smoothed local
    distances, their fuzzy union, principal components to begin with, and attraction and repulsion along sampled edges."""
    n, r = len(x), np.random.default_rng(seed)
    k = min(neighbours, n - 1)
    near, dist = np.empty((n, k), np.int64), np.empty((n, k))
    norms = (x * x).sum(axis=1)
    for at in range(0, n, 512):
        d = np.sqrt(np.maximum(0, norms[at : at + 512, None] + norms - 2 * x[at : at + 512] @ x.T))
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        near[at : at + 512], dist[at : at + 512] = top, np.take_along_axis(d, top, axis=1)
    w = fuzzy_weights(dist)
    a, b = np.repeat(np.arange(n), k), near.ravel()
    key, both = np.concatenate((a * n + b, b * n + a)), np.concatenate((w.ravel(), w.ravel()))
    edges, inverse = np.unique(key, return_inverse=True)
    total, product = np.zeros(len(edges)), np.ones(len(edges))
    np.add.at(total, inverse, both)
    np.multiply.at(product, inverse, both)
    twice = np.bincount(inverse) > 1
    weight = np.where(twice, total - product, total)
    heads, tails = edges // n, edges % n
    centred = x - x.mean(axis=0)
    y = centred @ np.linalg.svd(centred, full_matrices=False)[2][:dim].T
    y = np.pad(y, ((0, 0), (0, dim - y.shape[1])))
    y = y / (np.abs(y).max() + 1e-12) * 10 + r.normal(0, 1e-4, (n, dim))
    grid = np.linspace(0.001, 3, 300)
    wanted = np.where(grid <= min_dist, 1.0, np.exp(-(grid - min_dist)))
    p, q = min(((p, q) for p in np.linspace(0.5, 2.5, 41) for q in np.linspace(0.5, 1.5, 41)), key=lambda z: ((1 / (1 + z[0] * grid ** (2 * z[1])) - wanted) ** 2).sum())
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        hit = r.random(len(weight)) < weight / weight.max()
        i, j = heads[hit], tails[hit]
        d = y[i] - y[j]
        s = np.maximum((d * d).sum(axis=1, keepdims=True), 1e-12)
        pull = np.clip(-2 * p * q * s ** (q - 1) / (1 + p * s**q) * d, -4, 4) * rate
        np.add.at(y, i, pull)
        np.add.at(y, j, -pull)
        for _ in range(5):
            o = r.integers(0, n, len(i))
            d = y[i] - y[o]
            s = (d * d).sum(axis=1, keepdims=True)
            np.add.at(y, i, np.clip(2 * q / ((0.001 + s) * (1 + p * s**q)) * d, -4, 4) * rate * (o != i)[:, None])
    return y


def _unit(df: DataFrame) -> DataFrame:
    return with_columns(df, [wide(F.col("vec"))], "vec array<double>", lambda vec: [pa.array(list(unit_rows(matrix(vec))), pa.list_(pa.float64()))])


def _laid_out(x: DataFrame, dim: int, neighbours: int, min_dist: float, seed: int) -> DataFrame:
    """x with vec laid out: a sample of at most MOST_POINTS rows and SAMPLE_BYTES (first by a hash of their numbers, which go by image
    and index) in one task, all other rows among their nearest of it, as the sample's weights would be."""
    order = [c for c in ("image_id", "local_idx") if c in x.columns] or ["vec"]
    points, n = numbered(x, *order)
    if not n:
        return x
    size = len(points.select("vec").first()["vec"])
    most = max(neighbours + 1, min(MOST_POINTS, SAMPLE_BYTES // (8 * (size + dim))))
    sample = points.select("__i", "vec") if n <= most else points.select("__i", "vec").orderBy(F.xxhash64("__i"), "__i").limit(most)

    def lay(pdf):
        pdf = pdf.sort_values("__i", kind="stable").reset_index(drop=True)
        pdf["at"] = list(umap(np.stack(pdf["vec"].to_numpy()), dim, neighbours, min_dist, seed=seed))
        return pdf[["__i", "vec", "at"]]

    got = materialise(sample.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lay, "__i bigint, vec array<double>, at array<double>")).orderBy("__i").toArrow().combine_chunks()
    shared = x.sparkSession.sparkContext.broadcast((got.column(0).to_numpy(), matrix(got.column(1).chunk(0)), matrix(got.column(2).chunk(0))))

    def work(i, vec):
        known, a, laid = shared.value
        ids, v = i.to_numpy(), matrix(vec)
        place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        out, rest = laid[place], np.flatnonzero(known[place] != ids)
        norms, k = (a * a).sum(axis=1), min(neighbours, len(a))
        for at in range(0, len(rest), ROWS):
            own = rest[at : at + ROWS]
            d, _ = squared(v[own], a, norms)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            dist = np.sqrt(((v[own][:, None] - a[near]) ** 2).sum(axis=2))
            out[own] = (laid[near] * (w := fuzzy_weights(dist))[:, :, None]).sum(axis=1) / w.sum(axis=1, keepdims=True)
        return [pa.array(list(out), pa.list_(pa.float64()))]

    return with_columns(points, [F.col("__i"), F.col("vec")], "vec array<double>", work).drop("__i")


def reduce(descriptors: DataFrame, method: str = "none", dim: int = 10, neighbours: int = 15, min_dist: float = 0.0, seed: int = 42) -> DataFrame:
    """vec to unit length, then by `method` (none, pca, umap) to dim dimensions and to unit length again. umap lays out a
    bounded sample and puts all other points among it."""
    x = _unit(descriptors)
    if method == "none":
        return x
    if method == "umap":
        return _unit(_laid_out(x, dim, neighbours, min_dist, seed))
    if method != "pca":
        raise ValueError(f"no reducer {method!r}; there are none, pca and umap")
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    y = x.withColumn("__v", array_to_vector("vec"))
    model = PCA(k=dim, inputCol="__v", outputCol="__p").fit(y)
    return _unit(model.transform(y).withColumn("vec", vector_to_array("__p")).drop("__v", "__p"))


def density_clusters(descriptors: DataFrame, min_cluster_size: int = 5, min_samples: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """image_id, local_idx, label, prob; label -1 is noise. cells: image_id, local_idx, cell deal the points to tasks."""
    kind = descriptors.schema["image_id"].dataType.simpleString()
    x = descriptors.select("image_id", "local_idx", wide(F.col("vec")).alias("vec"))
    x = x.join(cells, ["image_id", "local_idx"]) if cells is not None else x.withColumn("cell", F.lit(0))
    over = x.groupBy("cell").count().where(F.col("count") > MOST_POINTS).collect()
    stride = max([MOST_POINTS, *(r["count"] for r in over)])

    def run(pdf):
        pdf = pdf.sort_values(["image_id", "local_idx"], kind="stable")
        labels, prob = leaf_clusters(np.stack(pdf["vec"].to_numpy()), min_cluster_size, min_samples)
        out = pdf[["image_id", "local_idx", "cell"]].copy()
        out["label"], out["prob"] = labels, prob.astype("float32")
        return out

    schema = f"image_id {kind}, local_idx int, cell int, label bigint, prob float"
    large = [r["cell"] for r in over]
    got = (x.where(~F.col("cell").isin(large)) if large else x).groupBy("cell").applyInPandas(run, schema)
    for cell in large:
        got = got.unionByName(_large_group(x.where(F.col("cell") == cell), min_cluster_size, min_samples, schema))
    label = F.when(F.col("label") < 0, F.lit(-1).cast("bigint")).otherwise(F.col("cell").cast("bigint") * stride + F.col("label"))
    return got.select("image_id", "local_idx", label.alias("label"), "prob")


def _large_group(x: DataFrame, min_cluster_size: int, min_samples: int, schema: str) -> DataFrame:
    points, n = numbered(x, "image_id", "local_idx")
    labels, prob = leaves_of(spanning_edges_of(points, n, min_samples), min_cluster_size)
    sent = points.sparkSession.sparkContext.broadcast((labels, prob.astype("float32")))

    def run(batches):
        for pdf in batches:
            out = pdf[["image_id", "local_idx", "cell"]].copy()
            out["label"], out["prob"] = (v[pdf["__i"].to_numpy()] for v in sent.value)
            yield out

    return points.drop("vec").mapInPandas(run, schema)

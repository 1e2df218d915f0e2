"""Labelled image folders as tables: scan, decode, preprocess, local descriptors.

images: dataset, image_id (class__stem), class, path. Files are listed by Spark's binaryFile reader, so any store
that Spark reads will do. Pixels: struct(height, width, channels, data), rows of blue, green, red bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.keypoints import sift_descriptors

SUFFIXES = ("jpg", "jpeg", "png", "bmp")
PIXELS = "height int, width int, channels int, data binary"


def _path(path):
    """Readers write local files with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def scan(spark: SparkSession, root: str, many: bool = False, content: bool = False) -> DataFrame:
    """root/<class>/<file>, or with many root/<dataset>/<class>/<file>; hidden folders are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    depth = 2 + many
    part = lambda k: F.element_at(F.split(F.col("path"), "/"), -k)
    name = part(1)
    x = files.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*SUFFIXES)).where(~part(depth).startswith(".") & ~part(2).startswith("."))
    base = F.element_at(F.split(F.lit(root.rstrip("/")), "/"), -1)
    below = F.size(F.split(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "/")) - F.size(F.split(F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/+", "/"), "/"))
    x = x.where(below == depth)
    return x.select((part(3) if many else base).alias("dataset"), F.concat(part(2), F.lit("__"), F.regexp_replace(name, r"\.[^.]+$", "")).alias("image_id"), part(2).alias("class"), _path(F.col("path")).alias("path"), *(["content"] if content else []))


def datasets(images: DataFrame) -> DataFrame:
    return images.groupBy("dataset").agg(F.count_distinct("class").alias("n_classes"), F.count(F.lit(1)).alias("n_images"))


def require_images(images: DataFrame, root: str) -> DataFrame:
    """Fails if there are none, or if two files share an id."""
    if not images.limit(1).count():
        raise ValueError(f"no class folders with images under {root}")
    twice = images.groupBy("dataset", "image_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files are {twice[0]['image_id']}")
    return images


def decode(spark: SparkSession, root: str) -> DataFrame:
    """path and pixels by Spark's image reader; files that can't be read are left out."""
    x = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    i = F.col("image")
    return x.select(_path(i["origin"]).alias("path"), F.struct(i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data")).alias("pixels"))


# --- kernels ------------------------------------------------------------------------------------------


def resize_area(img: np.ndarray, size: int) -> np.ndarray:
    """Means over the area that each new pixel covers."""

    def along(n: int) -> np.ndarray:
        edges = np.linspace(0, n, size + 1)
        at = np.arange(n)
        cover = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return np.rint(np.einsum("ih,hwc,jw->ijc", along(img.shape[0]), img.astype(np.float64), along(img.shape[1]))).clip(0, 255).astype(np.uint8)


def equalise(light: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation (Zuiderveld 1994) of a plane of bytes."""
    h, w = light.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(light, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    maps = np.empty((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            extra = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + extra / 256
            maps[i, j] = np.cumsum(hist) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, n: np.clip(a, 0, n - 1)
    get = lambda a, b: maps[at(a, tiles)[:, None], at(b, tiles)[None, :], light]
    out = (1 - fy) * ((1 - fx) * get(y0, x0) + fx * get(y0, x0 + 1)) + fy * ((1 - fx) * get(y0 + 1, x0) + fx * get(y0 + 1, x0 + 1))
    return np.rint(out).clip(0, 255).astype(np.uint8)


# sRGB to XYZ under daylight (D65), and that white.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(bgr: np.ndarray) -> np.ndarray:
    """Bytes of blue, green, red -> bytes of lightness (0 .. 255) and two colours (128: none)."""
    c = bgr[..., ::-1].astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = c @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * np.cbrt(t[..., 1]) - 16, 903.3 * t[..., 1])
    lab = np.stack((light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128), axis=-1)
    return np.rint(lab).clip(0, 255).astype(np.uint8)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """The way back."""
    light, a, b = np.moveaxis(lab.astype(np.float64), -1, 0)
    light, a, b = light * 100 / 255, a - 128, b - 128
    y = np.where(light > 903.3 * 0.008856, ((light + 16) / 116) ** 3, light / 903.3)
    fy = np.where(light > 903.3 * 0.008856, (light + 16) / 116, 7.787 * y + 16 / 116)
    f = np.stack((fy + a / 500, fy, fy - b / 200), axis=-1)
    t = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787)
    t[..., 1] = y
    c = (t * _WHITE) @ np.linalg.inv(_XYZ).T
    c = np.where(c > 0.0031308, 1.055 * np.maximum(c, 0) ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.rint(c[..., ::-1] * 255).clip(0, 255).astype(np.uint8)


def preprocess_image(img: np.ndarray, size: int = 128, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Grey to three channels, resized by area, lightness equalised, colours kept."""
    if img.ndim == 2 or img.shape[2] == 1:
        img = np.repeat(img.reshape(*img.shape[:2], 1), 3, axis=2)
    lab = to_lab(resize_area(img[:, :, :3], size))
    lab[..., 0] = equalise(lab[..., 0], tiles, clip)
    return from_lab(lab)


def gradient_descriptors(img: np.ndarray, patch: int = 16, step: int = 8) -> np.ndarray:
    """128 numbers per patch of a dense grid: 4 x 4 cells of 8 orientations weighted by magnitude, unit length, cut at
    0.2 and again unit length. Flat patches are left out."""
    grey = img.astype(np.float64).mean(axis=2)
    gy, gx = np.gradient(grey)
    size, turn = np.hypot(gx, gy), ((np.arctan2(gy, gx) / (2 * np.pi) * 8) % 8).astype(int)
    out = []
    cell = patch // 4
    for y in range(0, grey.shape[0] - patch + 1, step):
        for x in range(0, grey.shape[1] - patch + 1, step):
            s, t = size[y : y + patch, x : x + patch], turn[y : y + patch, x : x + patch]
            rows = (np.arange(patch) // cell)[:, None] * 4 + (np.arange(patch) // cell)[None, :]
            d = np.bincount((rows * 8 + t).ravel(), weights=s.ravel(), minlength=128)
            n = np.linalg.norm(d)
            if n > 1e-6:
                d = np.minimum(d / n, 0.2)
                out.append(d / np.linalg.norm(d))
    return np.array(out, np.float32).reshape(-1, 128)


#: Extractors by name: images -> (n, D) descriptors of each.
EXTRACTORS: dict[str, Callable[[list[np.ndarray]], list[np.ndarray]]] = {}


def register_extractor(name: str):
    """Register a function of one image."""

    def add(fn):
        EXTRACTORS[name] = lambda images: [fn(i) for i in images]
        return fn

    return add


register_extractor("gradient")(gradient_descriptors)
register_extractor("sift")(sift_descriptors)


def _pixels(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    return [np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"], p["channels"]) for p in batch.column(at).to_pylist()]


def preprocess(images: DataFrame, size: int = 128) -> DataFrame:
    """images: image_id, pixels -> image_id, pixels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [preprocess_image(i, size) for i in _pixels(b, 1)]
            rows = [{"height": m.shape[0], "width": m.shape[1], "channels": 3, "data": m.tobytes()} for m in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))], names=["image_id", "pixels"])

    return images.select("image_id", "pixels").mapInArrow(run, f"image_id string, pixels struct<{', '.join(c.replace(' ', ': ') for c in PIXELS.split(', '))}>")


def describe(images: DataFrame, extractor: str | Callable[[list[np.ndarray]], list[np.ndarray]] = "sift") -> DataFrame:
    """images: image_id, pixels -> a row per descriptor: image_id, local_idx, vec. extractor: a registered name, or a function
    of a list of images; what it needs is made in each worker."""
    if isinstance(extractor, str) and extractor not in EXTRACTORS:
        raise ValueError(f"no extractor {extractor!r}; there are {sorted(EXTRACTORS)}")
    kernel = EXTRACTORS[extractor] if isinstance(extractor, str) else extractor

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, places, vecs = [], [], []
                for i, d in zip(b.column(0).to_pylist(), kernel(_pixels(b, 1))):
                    ids += [i] * len(d)
                    places += range(len(d))
                    vecs += list(np.asarray(d, np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(places, pa.int32()), pa.array(vecs, pa.list_(pa.float32()))], names=["image_id", "local_idx", "vec"])

    return images.select("image_id", "pixels").mapInArrow(run, "image_id string, local_idx int, vec array<float>")


def pending(images: DataFrame, finished: DataFrame) -> DataFrame:
    """Images whose output isn't there yet."""
    return images.join(finished.select("image_id").distinct(), "image_id", "left_anti")

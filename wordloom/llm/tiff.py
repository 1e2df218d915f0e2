"""TIFF as a media column: build files, walk image directories, decode strips and tiles, one row per page.

Decoded: little and big endian; 1, 2, 4, 8, 16, 32 and 64 bits a sample, unsigned, signed or floating; any number of samples,
interleaved or in planes; strips or tiles; compression none, LZW, deflate (both codes) and PackBits; horizontal and
floating-point predictors. Pages are checked against the stored bytes before anything of their claimed size is made. Cases:

* null media: one row with page null and error 'null'; empty or broken media: one row with the reason in `error`, and so a
  broken page, while all others of its file are kept; an endless chain of directories is an error;
* null text: stored as the empty text; an empty text is one row of 64 zero bytes; a very long text is many pages;
* repeated rows give repeated rows, an empty table gives none, other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.llm.common import map_rows
from wordloom.session import table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH = 64
PAGE_ROWS = 1024
STRIP_ROWS = 256


class TiffError(ValueError):
    pass


# --- codecs -------------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes and more as runs, all else as literals."""
    out, n = bytearray(), len(data)
    if not n:
        return b""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(np.frombuffer(data, np.uint8))) + 1, [n]))
    long = np.flatnonzero(np.diff(edges) >= 3)
    literal = 0  # where the pending literal bytes begin

    def flush(upto: int) -> None:
        for k in range(literal, upto, 128):
            part = data[k : min(k + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, e in zip(edges[long].tolist(), edges[long + 1].tolist()):
        flush(s)
        for i in range(s, e, 128):
            run = min(128, e - i)
            out.extend((0 if run == 1 else 257 - run, data[i]))
        literal = e
    flush(n)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            if i >= n:
                raise TiffError("PackBits run without a byte")
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widths growing one code early."""
    acc = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    words: dict[bytes, int] = {bytes((k,)): k for k in range(256)}
    free, width, seen = 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        more = seen + data[k : k + 1]
        if more in words:
            seen = more
            continue
        put(words[seen], width)
        words[more] = free
        free += 1
        if free == 4095:
            put(256, width)
            words = {bytes((j,)): j for j in range(256)}
            free, width = 258, 9
        elif free + 1 > (1 << width) and width < 12:
            width += 1
        seen = data[k : k + 1]
    if seen:
        put(words[seen], width)
        free += 1
        if free + 1 > (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    words, out, made = list(base), [], 0
    acc = bits = at = 0
    width, last = 9, b""
    while made < size:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            acc = (acc << 8) | data[at]
            at += 1
            bits += 8
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            words, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        if code < len(words):
            now = words[code]
        elif code == len(words) and last:
            now = last + last[:1]
        else:
            raise TiffError("LZW code outside its table")
        out.append(now)
        made += len(now)
        if last:
            words.append(last + now[:1])
        last = now
        if len(words) + 2 > (1 << width) and width < 12:
            width += 1
    return b"".join(out)


def _pack(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(raw, 1)
    if compression == PACKBITS:
        return packbits_encode(raw)
    if compression == LZW:
        return lzw_encode(raw)
    raise TiffError(f"compression {compression}")


def _unpack(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = raw
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    elif compression == PACKBITS:
        out = packbits_decode(raw, size)
    elif compression == LZW:
        out = lzw_decode(raw, size)
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError(f"{len(out)} bytes where {size} belong")
    return out[:size]


# --- files --------------------------------------------------------------------------------------


def _packed_bits(rows: np.ndarray, bits: int) -> np.ndarray:
    """rows x values below 2 ** bits -> rows x bytes, the first value in the highest bits, rows padded to whole bytes."""
    ones = (rows[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(ones.reshape(len(rows), -1).astype(np.uint8), axis=1)


def _unpacked_bits(raw: bytes, rows: int, values: int, bits: int) -> np.ndarray:
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : values * bits].reshape(rows, values, bits)
    return (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def _chunk_bytes(chunk: np.ndarray, predictor: int, order: str, bits: int) -> bytes:
    """rows x columns x samples as stored before compression."""
    rows, columns, samples = chunk.shape
    if bits < 8:
        return _packed_bits(chunk.reshape(rows, -1), bits).tobytes()
    if predictor == 2:
        chunk = np.concatenate((chunk[:, :1], chunk[:, 1:] - chunk[:, :-1]), axis=1)
    elif predictor == 3:  # bytes in planes, the most significant first, each less the byte `samples` before
        planes = np.ascontiguousarray(chunk, chunk.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, columns * samples, -1)
        planes = planes.transpose(0, 2, 1).reshape(rows, -1, samples)
        return np.concatenate((planes[:, :1], planes[:, 1:] - planes[:, :-1]), axis=1).tobytes()
    return np.ascontiguousarray(chunk, chunk.dtype.newbyteorder(order)).tobytes()


def build(pages: list[np.ndarray], compressions: list[int], predictors: list[int] | int = 2, strip_rows: int = STRIP_ROWS, tiles: list[tuple[int, int] | None] | tuple[int, int] | None = None, order: str = "<", planar: bool = False, bits: int | None = None) -> bytes:
    """A TIFF of pages (rows x columns, or rows x columns x samples) of their types' bits, or of `bits` below 8. predictors and
    tiles (rows, columns) hold for all pages, or one is given for each."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for k, (page, compression) in enumerate(zip(pages, compressions)):
        predictor = predictors[k] if isinstance(predictors, list) else predictors
        tile = tiles[k] if isinstance(tiles, list) else tiles
        h, w = page.shape[:2]
        spp = page.shape[2] if page.ndim == 3 else 1
        cube = page.reshape(h, w, spp)
        places, counts = [], []
        for plane in [cube[:, :, i : i + 1] for i in range(spp)] if planar else [cube]:
            if tile:
                th, tw = tile
                wide = np.zeros((-(-h // th) * th, -(-w // tw) * tw, plane.shape[2]), page.dtype)
                wide[:h, :w] = plane
                chunks = [wide[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
            else:
                chunks = [plane[y : y + strip_rows] for y in range(0, h, strip_rows)]
            for chunk in chunks:
                raw = _pack(_chunk_bytes(chunk, predictor, order, bits or 8 * page.dtype.itemsize), compression)
                places.append(len(out))
                counts.append(len(raw))
                out += raw
                if len(out) & 1:
                    out.append(0)
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits or 8 * page.dtype.itemsize] * spp), (259, 3, [compression]), (262, 3, [2 if spp >= 3 else 1]), (277, 3, [spp])]
        tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, 4, places), (325, 4, counts)] if tile else [(273, 4, places), (278, 4, [strip_rows]), (279, 4, counts)]
        tags += [(317, 3, [predictor])] if predictor > 1 else []
        tags += [(284, 3, [2])] if planar else []
        tags += [(339, 3, [{"u": 1, "i": 2, "f": 3}[page.dtype.kind]] * spp)] if page.dtype.kind != "u" else []
        entries = bytearray()
        for tag, t, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{'H' if t == 3 else 'I'}", *values)
            if len(body) > 4:
                at = len(out)
                out += body
                if len(out) & 1:
                    out.append(0)
                body = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, t, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries) // 12) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
_BROKEN = (TiffError, struct.error, IndexError, ValueError, OverflowError, MemoryError)


def pages(media: bytes, broken: bool = False) -> Iterator[dict]:
    """Walk the image directories of a TIFF; a dict a page, pixels as rows x columns x samples. broken: a page that can't be
    decoded is a dict of its number and error, and the walk goes on."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if not order or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise TiffError("not a TIFF")
    at, seen, number = struct.unpack_from(order + "I", media, 4)[0], set(), 0
    while at:
        if at in seen:
            raise TiffError("directories form a ring")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", media, at)
            here, at = at, struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]
        except struct.error as e:
            raise TiffError(f"directory past the end: {e}") from e
        try:
            page = _page(media, order, _tags(media, order, here, n), number)
        except _BROKEN as e:
            if not broken:
                raise e if isinstance(e, TiffError) else TiffError(str(e)) from e
            page = {"page": number, "error": str(e) or type(e).__name__}
        yield page
        number += 1


def _tags(media: bytes, order: str, at: int, n: int) -> dict[int, tuple]:
    """A directory's tags of whole numbers that have values."""
    tags: dict[int, tuple] = {}
    for entry in range(at + 2, at + 2 + 12 * n, 12):
        tag, t, count = struct.unpack_from(order + "HHI", media, entry)
        if t in _SIZES and count:
            code, size = _SIZES[t]
            place = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", media, entry + 8)[0]
            if place + size * count > len(media):
                raise TiffError(f"tag {tag} past the end")
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", media, place)
    return tags


def _kind(bits: int, sign: int) -> np.dtype:
    if (sign == 3 and bits not in (16, 32, 64)) or (sign == 2 and bits < 8) or sign not in (1, 2, 3) or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError(f"{bits} bits of format {sign}")
    return np.dtype(f"{'uif'[sign - 1]}{max(1, bits // 8)}")


def _page(media: bytes, order: str, tags: dict[int, tuple], number: int) -> dict:
    try:
        w, h = tags[256][0], tags[257][0]
        spp, bits, sign = tags.get(277, (1,))[0], tags.get(258, (1,)), tags.get(339, (1,))
        compression, predictor, planes = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0]
        tiled = 324 in tags
        th, tw = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (h,))[0], h), w)
        places, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    except KeyError as e:
        raise TiffError(f"tag {e} is missing") from e
    kind = _kind(bits[0], sign[0])
    if len({*bits}) > 1 or len({*sign}) > 1 or predictor not in (1, 2, 3) or planes not in (1, 2) or tags.get(266, (1,))[0] != 1:
        raise TiffError(f"bits {bits}, formats {sign}, predictor {predictor}, planes {planes}")
    bits = bits[0]
    if (predictor == 3 and kind.kind != "f") or (predictor == 2 and (bits < 8 or kind.kind == "f")):
        raise TiffError(f"predictor {predictor} on {bits} bits")
    if not (w and h and th and tw and spp):
        raise TiffError("a page without pixels")
    wide, high, layers = -(-w // tw), -(-h // th), spp if planes == 2 else 1
    if len(places) != wide * high * layers or len(counts) != len(places):
        raise TiffError("strips or tiles don't cover the page")
    each, chunks = spp // layers, []
    for k, (place, count) in enumerate(zip(places, counts)):
        rows = th if tiled else min(th, h - k % (wide * high) // wide * th)
        line = -(-tw * each * bits // 8)
        if place + count > len(media) or rows * line > 1 << 40:
            raise TiffError("data past the end")
        chunks.append((rows, _unpack(media[place : place + count], compression, rows * line)))  # as long as the data are, at most
    cube = np.empty((h, w, spp), kind)
    for k, (rows, raw) in enumerate(chunks):
        layer, k = divmod(k, wide * high)
        y, x = k // wide * th, k % wide * tw
        if bits < 8:
            chunk = _unpacked_bits(raw, rows, tw * each, bits).reshape(rows, tw, each)
        elif predictor == 3:
            planes_ = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, each), axis=1, dtype=np.uint8)
            chunk = np.ascontiguousarray(planes_.reshape(rows, kind.itemsize, -1).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, tw, each)
        else:
            chunk = np.frombuffer(raw, kind.newbyteorder(order)).reshape(rows, tw, each).astype(kind, copy=False)
            if predictor == 2:
                chunk = np.cumsum(chunk, axis=1, dtype=kind)
        own = slice(layer, layer + 1) if layers > 1 else slice(None)
        cube[y : y + rows, x : x + tw, own] = chunk[: h - y, : w - x]
    return {"page": number, "width": w, "height": h, "samples": spp, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": cube}


# --- documents as media ---------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


KINDS = (LZW, PACKBITS, DEFLATE)


def encode_payload(payload: bytes) -> bytes:
    """Grey pages of 64 columns and up to 1,024 rows. The payload's checksum says how the first page is coded and in which byte
    order; from page to page LZW, PackBits and deflate, then strips and tiles, then predictors take turns."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)]
    first = zlib.crc32(payload)
    turns = [(first >> 1) + k for k in range(len(parts))]
    kinds = [KINDS[t % 3] for t in turns]
    tiles = [(min(STRIP_ROWS, -(-len(p) // 16) * 16), WIDTH) if t // 3 % 2 else None for t, p in zip(turns, parts)]
    return build(parts, kinds, [1 if kind == PACKBITS or t // 6 % 2 else 2 for t, kind in zip(turns, kinds)], tiles=tiles, order="<>"[first & 1])


def encode_column(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (unpadded) and media, a TIFF of the whole text."""

    def run(x: dict) -> dict:
        made = [payload_of(t) for t in x["t"]]
        return {"k": x["k"], "n_bytes": [n for _, n in made], "media": [encode_payload(p) for p, _ in made]}

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), f"k {kind}, n_bytes bigint, media binary", run, ["k", "t"]).withColumnRenamed("k", key)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def decode_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page: the kept columns, page, its shape and coding, pixels row by row (values of the machine's byte order);
    what is broken says so in error. A file's pages come out one after another."""
    names = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
    own = [f"k{i}" for i in range(len(keep))]

    def run(x: dict) -> dict:
        rows: list[dict] = []
        for m, *k in zip(x["m"], *(x[c] for c in own)):
            kept = dict(zip(own, k))
            try:
                if m is None:
                    raise TiffError("null")
                for p in pages(bytes(m), broken=True):
                    rows.append(p | kept | ({"pixels": p["pixels"].tobytes(), "error": None} if "pixels" in p else {}))
            except TiffError as e:
                rows.append(kept | {"error": str(e)})
        return {n: [r.get(n) for r in rows] for n in [*own, *names]}

    schema = ", ".join([f"{o} {df.schema[c].dataType.simpleString()}" for o, c in zip(own, keep)] + [PAGE_SCHEMA])
    made = map_rows(df.select(F.col(media).alias("m"), *[F.col(c).alias(o) for o, c in zip(own, keep)]), schema, run, ["m", *own])
    return made.toDF(*keep, *names)


def feature_of(columns: np.ndarray, squares: int, rows: int, n_pages: int) -> str:
    """Pages, size, mean, spread and a 64-bit average hash over the columns' sums."""
    bits, n = columns * WIDTH > columns.sum(), rows * WIDTH
    mean = int(columns.sum()) / n
    spread = max(0.0, squares / n - mean * mean) ** 0.5
    return f"{n_pages}p{WIDTH}x{rows};{mean:.3f};{spread:.3f};{int(''.join('01'[int(b)] for b in bits), 2):016x}"


def digests(decoded: DataFrame, key: str = "doc_id", n_bytes: str = "n_bytes") -> DataFrame:
    """Describe the payload that the pages of each file hold together. decoded: rows of decode_pages as they come out, with
    key, n_bytes, media_bytes and media_sha256 kept; a page that can't be read is an error."""
    schema = f"k {decoded.schema[key].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pages bigint"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def row() -> tuple:
            k, n, size, sha = now[0]
            return k, n, now[1] * WIDTH, now[2].hexdigest(), zlib.crc32(now[3]), size, sha, feature_of(now[4], now[5], now[1], now[6]), now[6]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            rows = []
            for page, pixels, error, *own in zip(*(c.to_pylist() for c in batch.columns)):
                if error is not None:
                    raise ValueError(f"stored media of {own[0]}: {error}")
                if page == 0:
                    if now:
                        rows.append(row())
                    now = [own, 0, hashlib.sha256(), b"", np.zeros(WIDTH, np.int64), 0, 0]
                grid = np.frombuffer(pixels, np.uint8).reshape(-1, WIDTH)
                now[1] += len(grid)
                now[2].update(pixels)
                now[3] = pixels[-WIDTH:]
                now[4] += grid.sum(axis=0, dtype=np.int64)
                now[5] += int((np.bincount(grid.ravel(), minlength=256) * np.arange(256) ** 2).sum())
                now[6] += 1
            yield batch_of(rows)
        if now:
            yield batch_of([row()])

    return decoded.select("page", "pixels", "error", key, n_bytes, "media_bytes", "media_sha256").mapInArrow(run, schema).withColumnRenamed("k", key)


def op1_tiff(spark, sf_dir: str) -> DataFrame:
    stored = encode_column(table(spark, sf_dir, "documents"))
    stored = stored.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return digests(decode_pages(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256")))

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import tiff


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("data", [b"a" * 5000, bytes(range(256)) * 60, b"ab" * 40_000, np.random.default_rng(0).integers(0, 255, 30_000, dtype=np.uint8).tobytes()])
def test_long_runs_and_full_tables(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_known_packbits():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize(("shape", "kind"), [((37, 50), np.uint8), ((20, 33, 3), np.uint8), ((21, 17), np.uint16), ((9, 40, 2), np.int32)])
def test_files_round_trip(compression, predictor, tile, order, planar, shape, kind):
    r = np.random.default_rng(1)
    made = [r.integers(0, np.iinfo(kind).max, shape, dtype=kind), np.full(shape, 7, kind)]
    got = list(tiff.pages(tiff.build(made, [compression] * 2, predictor, 8, tile, order, planar)))
    assert [g["page"] for g in got] == [0, 1]
    for g, m in zip(got, made):
        assert (g["pixels"].reshape(m.shape) == m).all()
        assert g["compression"] == compression
        assert g["tiled"] == bool(tile)


@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 3])
@pytest.mark.parametrize("kind", [np.float16, np.float32, np.float64])
def test_floating_samples(tile, order, predictor, kind):
    made = np.random.default_rng(2).normal(size=(21, 35, 2)).astype(kind)
    (got,) = tiff.pages(tiff.build([made], [tiff.DEFLATE], predictor, 8, tile, order))
    assert got["pixels"].dtype == kind and (got["pixels"] == made).all()


def test_floating_predictor_by_hand():
    """Two floats a row: four planes of bytes, the most significant first, each byte less the one before it."""
    raw = np.array([[1.5, -2.25]], ">f4").tobytes()
    planes = [raw[0], raw[4], raw[1], raw[5], raw[2], raw[6], raw[3], raw[7]]
    stored = bytes((b - a) % 256 for a, b in zip([0, *planes], planes))
    assert tiff._chunk_bytes(np.array([[[1.5], [-2.25]]], np.float32), 3, "<", 32) == stored


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("samples", [1, 3])
def test_samples_below_a_byte(bits, tile, samples):
    made = np.random.default_rng(3).integers(0, 1 << bits, (19, 37, samples), dtype=np.uint8)
    (got,) = tiff.pages(tiff.build([made], [tiff.PACKBITS], 1, 8, tile, bits=bits))
    assert got["bits"] == bits and (got["pixels"] == made).all()


def good_file(order="<"):
    return tiff.build([np.full((10, 64), 120, np.uint8)], [tiff.DEFLATE], order=order)


def test_broken_files():
    good = good_file()
    for bad in (b"", b"II", good[:-20], b"MM" + good[2:], good[:4] + b"\xff\xff\x00\x00" + good[8:]):
        with pytest.raises(tiff.TiffError):
            list(tiff.pages(bad))
    ring = bytearray(good)
    at = int.from_bytes(ring[4:8], "little")
    n = int.from_bytes(ring[at : at + 2], "little")
    ring[at + 2 + 12 * n : at + 6 + 12 * n] = ring[4:8]
    with pytest.raises(tiff.TiffError, match="ring"):
        list(tiff.pages(bytes(ring)))


def changed(media, tag, kind=None, count=None, value=None):
    """The file with one entry of its first directory overwritten."""
    out = bytearray(media)
    at = int.from_bytes(out[4:8], "little")
    for k in range(int.from_bytes(out[at : at + 2], "little")):
        e = at + 2 + 12 * k
        if int.from_bytes(out[e : e + 2], "little") == tag:
            for place, size, new in ((e + 2, 2, kind), (e + 4, 4, count), (e + 8, 4, value)):
                if new is not None:
                    out[place : place + size] = new.to_bytes(size, "little")
    return bytes(out)


@pytest.mark.parametrize("tag", [256, 257, 258, 259, 273, 277, 278, 279, 317])
@pytest.mark.parametrize("change", [{"count": 0}, {"count": 0xFFFFFFFF}, {"value": 0}, {"value": 0xFFFFFFFF}, {"kind": 4, "value": 200_000}, {"kind": 99}])
def test_every_tag_broken_in_every_way(tag, change):
    """A page row or an error row, never another exception, and nothing of a claimed size is made."""
    import tracemalloc

    tracemalloc.start()
    (page,) = tiff.pages(changed(good_file(), tag, **change), broken=True)
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()
    assert ("error" in page) != ("pixels" in page)


def test_a_page_that_claims_to_be_huge():
    media = changed(changed(changed(good_file(), 256, value=200_000), 257, value=200_000), 278, value=200_000)
    (page,) = tiff.pages(media, broken=True)
    assert "where 40000000000 belong" in page["error"]


@given(st.integers(0, 10**6), st.lists(st.tuples(st.floats(0, 1), st.integers(0, 255)), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_spoilt_bytes(seed, changes):
    media = bytearray(tiff.encode_payload(np.random.default_rng(seed).integers(0, 99, 64 * (seed % 40 + 1), dtype=np.uint8).tobytes()))
    for place, value in changes:
        media[int(place * (len(media) - 1))] = value
    try:
        for page in tiff.pages(bytes(media), broken=True):
            assert ("error" in page) != ("pixels" in page)
    except tiff.TiffError:
        pass


def test_codings_take_turns():
    found = set()
    for k in range(80):
        for p in tiff.pages(tiff.encode_payload(bytes([k + 1]) * 64 * (1 + k * 40))):
            found.add((p["compression"], p["tiled"], p["predictor"]))
    assert found == {(c, t, p) for c in tiff.KINDS for t in (False, True) for p in (1, 2) if (c, p) != (tiff.PACKBITS, 2)}


TEXTS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 70_000), (5, "abc"), (6, "x" * 64), (7, "a b\n" * 900), (None, "no id")]


def stored(df):
    x = tiff.encode_column(df)
    x = x.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return tiff.digests(tiff.decode_pages(x, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256")))


def feature(payload, pages):
    """By plain sums."""
    columns = [sum(payload[k::64]) for k in range(64)]
    mean, square = sum(payload) / len(payload), sum(b * b for b in payload) / len(payload)
    bits = "".join("1" if c * 64 > sum(columns) else "0" for c in columns)
    return f"{pages}p64x{len(payload) // 64};{mean:.3f};{max(0.0, square - mean * mean) ** 0.5:.3f};{int(bits, 2):016x}"


def check_rows(got, texts):
    assert len(got) == len(texts)
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media, r = tiff.encode_payload(payload), got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["pages"] == -(-len(payload) // (64 * 1024)) and r["feature"] == feature(payload, r["pages"])


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in TEXTS], "doc_id long, text string, media string, n_bytes int").repartition(3)
    got = {r["doc_id"]: r for r in stored(df).collect()}
    check_rows(got, TEXTS)
    assert got[1]["media_sha256"] == got[5]["media_sha256"]
    assert got[1]["feature"] == got[5]["feature"]
    assert got[4]["pages"] > 1


def test_page_rows(spark):
    media = [(1, bytearray(tiff.encode_payload(b"z" * 64 * 2050))), (2, None), (3, bytearray(b"junk"))]
    rows = tiff.decode_pages(spark.createDataFrame(media, "doc_id long, media binary")).collect()
    assert [(r["page"], r["height"]) for r in rows if r["doc_id"] == 1] == [(0, 1024), (1, 1024), (2, 2)]
    assert {r["doc_id"]: r["error"] for r in rows if r["error"]} == {2: "null", 3: "not a TIFF"}
    assert tiff.decode_pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def test_query(spark, small):
    got = {r["doc_id"]: r for r in tiff.op1_tiff(spark, small).collect()}
    check_rows(got, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_pages_after_a_broken_one_are_kept(spark):
    grids = [np.full((4, 64), v, np.uint8) for v in (1, 2, 3)]
    media = bytearray(tiff.build(grids, [tiff.NONE, tiff.DEFLATE, tiff.NONE], predictors=1))
    packed = tiff._pack(grids[1].tobytes(), tiff.DEFLATE)
    at = bytes(media).index(packed)
    media[at : at + len(packed)] = b"\xff" * len(packed)
    rows = tiff.decode_pages(spark.createDataFrame([(1, bytes(media))], "doc_id long, media binary")).orderBy("page").collect()
    assert [r["page"] for r in rows] == [0, 1, 2]
    assert [r["pixels"] and bytes(r["pixels"]) for r in rows] == [grids[0].tobytes(), None, grids[2].tobytes()]
    assert rows[1]["error"].startswith("deflate") and rows[0]["error"] is None is rows[2]["error"]

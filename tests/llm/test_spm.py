import pytest
import sentencepiece
from pyspark.sql import functions as F

from wordloom.llm import spm
from wordloom.llm.common import vocabulary_path

HARD = ["", " ", "  a  b ", "\n\n x", "日本語 text 🎉\u200b", "a\tb", "<0x0A> <unk> <s>", "e\u0301", "aaaaaaa  bbbbb   ", "x" * 3000, "\x00\x01", "abababab ababab", "....!!!! ----", "a" + " b" * 20_000]


def test_parity_on_hard_texts():
    path = vocabulary_path("piece_bpe_32k.model")
    judge, codec = sentencepiece.SentencePieceProcessor(model_file=path), spm.Codec(path, 1)
    for t in [*HARD, "▁▁a ▁b", "\n\nx\n y", "\n", " \n ", "  "]:
        ids = codec.encode([t])[0]
        assert ids.tolist() == judge.encode(t)
        assert codec.decode(ids) == judge.decode(ids.tolist())


def test_whole_text_form_agrees(monkeypatch):
    path = vocabulary_path("piece_bpe_32k.model")
    monkeypatch.setattr(spm.Model, "cuttable", lambda self: False)
    judge, codec = sentencepiece.SentencePieceProcessor(model_file=path), spm.Codec(path)
    assert [i.tolist() for i in codec.encode(HARD)] == [judge.encode(t) for t in HARD]


def unigram_model():
    """A small unigram model with byte fallback, written field by field."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes((n & 127 | 128,)), n >> 7
        return out + bytes((n,))

    def part(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("▁the", -3.0, 1), ("▁cat", -4.0, 1), ("s", -3.5, 1), ("c", -5.0, 1), ("a", -5.0, 1), ("t", -5.0, 1), ("h", -5.0, 1), ("e", -5.0, 1), ("at", -4.5, 1), ("▁ca", -4.2, 1)]
    out = b"".join(part(1, part(1, t.encode()) + b"\x15" + struct.pack("<f", s) + (b"\x18" + varint(k) if k != 1 else b"")) for t, s, k in pieces)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1) + varint(4 << 3) + varint(len(pieces))
    normal = part(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1)
    return out + part(2, trainer) + part(3, normal)


def test_unigram_model(tmp_path):
    path = tmp_path / "u.model"
    path.write_bytes(unigram_model())
    judge, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), spm.Codec(str(path))
    assert not codec.cuts
    for t in ["the cats", "the  cat ", "cat", "aé", "", "hat at the cat"]:
        assert codec.encode([t])[0].tolist() == judge.encode(t), t


def test_every_chunk_is_judged_when_it_is_encoded(monkeypatch):
    """One wrong chunk anywhere in a text fails, whichever text it is in."""
    path = vocabulary_path("piece_bpe_32k.model")
    right = spm.Codec._ids
    for bad in ("▁zebra", "after\tfeed", "▁▁two"):
        monkeypatch.setattr(spm.Codec, "_ids", lambda self, texts, bad=bad: (ids + [5] if w == bad else ids for w, ids in zip(texts, right(self, texts))))
        codec = spm.Codec(path, 10**9)
        codec.encode(["first text", "second text", "third text"])
        with pytest.raises(ValueError, match="no parity"):
            codec.encode(["a fine text", "lines\nafter\tfeed and  two zebra ends"])


def test_library_decoder_agrees():
    codec = spm.Codec(vocabulary_path("piece_bpe_32k.model"))
    core = codec.model.tokenizer()
    for t in HARD[2:]:
        ids = codec.encode([t])[0]
        assert core.decode(ids.tolist(), skip_special_tokens=False) == codec.decode(ids)


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0), (1, "hello world", 0)], "doc_id long, text string, piece_ids int")
    made = spm.encode_texts(df, verify_every=1)
    assert made.columns == ["doc_id", "text", "piece_ids"]
    rows = spm.decode_ids(made).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == ["hello world", "hello world", None, ""]
    assert rows[2]["piece_ids"] is None
    assert spm.encode_texts(df.limit(0)).count() == 0


def test_query(spark, small):
    """Every id of every document is the library's."""
    judge = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    judged = spark.createDataFrame([(i, judge.encode(t)) for i, t in texts.items()], "doc_id long, ids array<int>")
    hashes = {r["doc_id"]: r["h"] for r in judged.select("doc_id", F.xxhash64("ids").alias("h")).collect()}
    got = spm.op6_sentencepiece(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["round_trip"] and r["pieces_hash"] == hashes[r["doc_id"]]
        assert r["decoded_bytes"] == len(texts[r["doc_id"]].encode())

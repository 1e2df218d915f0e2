"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (wire format only), and the pipeline rebuilt from what it says: the
normaliser (its character map, extra white space, dummy prefix), the metaspace mark, unigram scores or, in a
BPE model, merges ranked by the scores, and byte fallback. Batches are encoded by the library's threads.

No piece of the usual models holds a mark after other characters, nor a line feed, so a normalised text can be
cut before each run of marks and around line feeds without changing its segmentation; then each distinct
chunk is encoded once and remembered (a bounded memory). A model with such pieces, and any unigram model, is
encoded text by text instead. Parity with the SentencePiece library is verified on every chunk when it is encoded (on every
text, where texts are encoded whole or the model normalises), and on the first whole texts that every worker sees and every `verify_every`-th
after them, with what they decode to; where one differs the task fails, naming it.

Cases: null texts give null ids and decode to null; empty texts give no ids; repeated rows are repeated;
very long texts are encoded whole; an empty table gives none; other columns pass through, those named like the new
ones are replaced.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import append_column, library_threads, vocabulary_path, worker_state
from wordloom.session import table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks remembered per worker process, in two generations: when the younger one is full it replaces the older.
REMEMBERED = 480_000
#: Chunks that the library's threads get at a time: what it returns for each is many times as large as its ids.
AT_ONCE = 2048
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


class Model:
    """What a model file says: pieces with scores and kinds, the trainer's and the normaliser's settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.type, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        for n, v in _fields(data):
            if n == 1:
                text, score, kind = "", 0.0, NORMAL
                for k, x in _fields(v):
                    if k == 1:
                        text = x.decode("utf-8")
                    elif k == 2:
                        (score,) = struct.unpack("<f", x)
                    elif k == 3:
                        kind = x
                self.pieces.append((text, score, kind))
            elif n == 2:
                got = dict(_fields(v))
                self.type, self.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif n == 3:
                got = dict(_fields(v))
                self.charsmap = got.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        self.unk_id = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first."""
        rank = {t: i for i, (t, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for t, i in rank.items():
            for k in range(1, len(t)):
                if t[:k] in rank and t[k:] in rank:
                    found.append((-self.pieces[i][1], i, rank[t[:k]], rank[t[k:]], t[:k], t[k:]))
        return [(x[4], x[5]) for x in sorted(found)]

    def normalizer(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def tokenizer(self, normalise: bool = True):
        from tokenizers import Tokenizer, decoders, models, normalizers

        if self.type == UNIGRAM:
            core = models.Unigram([(t, s) for t, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.type == BPE:
            core = models.BPE({t: i for i, (t, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.type}")
        made = Tokenizer(core)
        made.normalizer = self.normalizer() if normalise else normalizers.Sequence([])
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return made

    def cuttable(self) -> bool:
        return self.type == BPE and self.escape and not any(kind in (NORMAL, USER_DEFINED) and (MARK in t.lstrip(MARK) or "\n" in t) for t, _, kind in self.pieces)


class Codec:
    """Encodes and decodes with a rebuilt tokenizer."""

    def __init__(self, path: str, verify_every: int = 0):
        with open(path, "rb") as f:
            data = f.read()
        self.model = Model(data)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cuts = self.model.cuttable()
        self.normalizer = self.model.normalizer()
        self._core = None
        self.plain = not self.model.charsmap and not self.model.trim and self.model.dummy_prefix
        self.bytes_of = [b"" if kind in (CONTROL,) else bytes((int(t[3:5], 16),)) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else t.replace(MARK, " ").encode("utf-8") for t, _, kind in self.model.pieces]
        self.verify_every, self.seen, self.judge = verify_every, 0, None
        if verify_every:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)

    @property
    def core(self):
        """The tokenizer, made when something is first encoded: of chunks that are normalised already, or of texts."""
        if self._core is None:
            library_threads()
            self._core = self.model.tokenizer(normalise=not self.cuts)
        return self._core

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out = self._cut(texts) if self.cuts else self._whole(texts)
        if self.judge:
            self._verify(texts, out)
        return out

    def _ids(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), AT_ONCE):
            for e in self.core.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False):
                yield e.ids

    def _whole(self, texts: list[str | None]) -> list[np.ndarray | None]:
        got = self._ids([t for t in texts if t is not None])
        out = [None if t is None else np.array(next(got), np.int32) for t in texts]
        if self.judge:
            for t, ids in zip(texts, out):
                if t is not None and self.judge.encode(t) != ids.tolist():
                    raise ValueError(f"no parity on {t[:80]!r}")
        return out

    def _judged(self, chunks: list[str]) -> Iterator[list[int]]:
        """What the library makes of chunks of normalised text. It puts a mark before every text: a chunk that begins with one
        comes without it, any other after a line feed, whose pieces are dropped."""
        before = len(self.judge.encode("\n"))
        asked = [c[1:].replace(MARK, " ") if c[0] == MARK else "\n" + c for c in chunks]
        for c, ids in zip(chunks, self.judge.encode(asked, num_threads=1)):
            yield ids if c[0] == MARK else ids[before:]

    def _cut(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.memory) > REMEMBERED // 2:
            self.older, self.memory = self.memory, {}
        memory, parts = self.memory, []  # of a batch, which is cut by bytes
        new: dict[str, None] = {}
        for t in texts:
            if not t:
                parts.append(None if t is None else [])
                continue
            normal = (MARK + t.replace(" ", MARK)) if self.plain else self.normalizer.normalize_str(t)
            words = _CHUNK.findall(normal)
            parts.append(words)
            new.update((w, None) for w in words if w not in memory)
        words = []
        for w in new:
            if w in self.older:
                memory[w] = self.older[w]
            else:
                words.append(w)
        for at in range(0, len(words), AT_ONCE):
            few = words[at : at + AT_ONCE]
            made = list(self._ids(few))
            if self.judge and self.plain:  # a model that normalises is judged by whole texts: chunks would be normalised twice
                for w, ids, right in zip(few, made, self._judged(few)):
                    if ids != right and w != MARK:  # the library makes nothing of an empty text
                        raise ValueError(f"no parity on the chunk {w[:80]!r}")
            memory.update((w, array("i", ids).tobytes()) for w, ids in zip(few, made))
        return [None if p is None else np.frombuffer(b"".join(map(memory.__getitem__, p)), np.int32) for p in parts]

    def _verify(self, texts: list[str | None], out: list[np.ndarray | None]) -> None:
        for t, ids in zip(texts, out):
            if t is not None:
                self.seen += 1
                if self.seen <= 2 or self.seen % self.verify_every == 0 or (self.cuts and not self.plain):
                    if self.judge.encode(t) != ids.tolist():
                        raise ValueError(f"no parity on {t[:80]!r}")
                    if self.decode(ids) != self.judge.decode(ids.tolist()):
                        raise ValueError(f"decoding differs on {t[:80]!r}")

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join([self.bytes_of[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def _codec(path: str, verify_every: int = 0) -> Codec:
    """One per worker process, so what it remembers serves later tasks too."""
    return worker_state(("pieces", path, verify_every), lambda: Codec(path, verify_every))


def encode_texts(df: DataFrame, text: str = "text", model_path: str | None = None, verify_every: int = 997, ids: str = "piece_ids", keep: bool = True) -> DataFrame:
    """df with a column of piece ids; keep: with its texts."""
    path = model_path or vocabulary_path("piece_bpe_32k.model")

    def work():
        codec = _codec(path, verify_every)

        def state(column: pa.Array) -> pa.Array:
            got = codec.encode(column.to_pylist())
            sizes = np.cumsum([0, *(0 if g is None else len(g) for g in got)])
            if sizes[-1] > 2**31 - 1:
                raise ValueError("a batch has over 2^31 pieces")
            flat = np.concatenate([g for g in got if g is not None] or [np.empty(0, np.int32)])
            gone = pa.array([g is None for g in got])
            return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()), mask=gone)

        return state

    return append_column(df, text, "array<int>", ids, work, keep)


def decode_ids(df: DataFrame, ids: str = "piece_ids", model_path: str | None = None, text: str = "decoded", keep: bool = True) -> DataFrame:
    """df with a column of decoded texts; keep: with its ids."""
    path = model_path or vocabulary_path("piece_bpe_32k.model")

    def work():
        codec = _codec(path)

        def state(column: pa.Array) -> pa.Array:
            starts, flat = column.offsets.to_numpy(), column.values.to_numpy()
            ok = column.is_valid().to_pylist()
            return pa.array([codec.decode(flat[a:b]) if v else None for a, b, v in zip(starts[:-1], starts[1:], ok)], pa.string())

        return state

    return append_column(df, ids, "string", text, work, keep)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded, decoded again, and compared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "text")
    made = encode_texts(docs, keep=False)
    back = decode_ids(made.select("doc_id", "text_crc32", F.size("piece_ids").cast("bigint").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"), "piece_ids"), keep=False)
    return back.select(
        "doc_id",
        "n_pieces",
        "pieces_hash",
        F.octet_length("decoded").cast("bigint").alias("decoded_bytes"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        F.coalesce(F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32"), F.lit(True)).alias("round_trip"),
    )

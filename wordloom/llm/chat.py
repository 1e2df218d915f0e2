"""Offset-aligned loss masks: whole conversations are rendered, encoded once with offsets, and the sorted
turn spans are intersected with the token spans by binary search.

Template: `### `, the role, a line feed, the text, `</turn>` and a line feed. Inside roles and texts a
backslash goes before every backslash, every # of a run of three or more and every < that begins `</turn>`
(in roles before line feeds too), so no text can pose as a mark, and dropping each backslash's first
character restores it.

The tokenizer gets a conversation in pieces cut at the borders of its texts, so no token straddles template and text, and
what is masked is the texts, to the character; a tokenizer whose tokens leave characters out is an error. For the same
reason a conversation's tokens don't depend on where it is cut between turns: its rows are dealt to tasks by runs of
PART_TURNS turn numbers, so a hot conversation (or all rows without a conv_id) is encoded in many tasks, and a run comes
out in segments of about `segment_chars` characters, so memory doesn't grow with it. Cases:

* null or empty text: an empty turn; null role: an empty role; null turn numbers come first; null conv_id is
  one conversation; equal turn numbers are ordered by role, then text; repeated rows are repeated turns;
* a very long text is one turn of one segment, encoded whole;
* an empty table gives no rows; other columns, whatever their names, are not looked at;
* a conversation without assistant turns has an empty mask (0 characters, the hash of nothing).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.llm.common import library_threads, vocabulary_path
from wordloom.session import table

_TEXT = re.compile(r"\\|#{3,}|<(?=/turn>)")
_ROLE = re.compile(r"\\|#{3,}|<(?=/turn>)|\n")
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\\n]+|\\.)*+)\n((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.S)

SEGMENTS = "conv_id bigint, part bigint, segment int, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>"
#: Turn numbers of a conversation that are encoded in one task.
PART_TURNS = 4096


def _escaped(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: "".join("\\" + c for c in m[0]), text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]], learn: str = "assistant") -> tuple[list[str], list[tuple[int, int]]]:
    """The formatted text in pieces (a turn's head, text and end), and the sorted spans of the texts to learn from."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {_escaped(role or '', _ROLE)}\n", _escaped(text or "", _TEXT)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += (head, body, "</turn>\n")
        at += len(head) + len(body) + 8
    return pieces, spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds; what isn't a whole turn is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """A mask over tokens, 1 where a token holds characters of a span. Token starts and ends don't fall, so each span's
    tokens are found by two binary searches. Tokens must cover each span exactly."""
    mask = np.zeros(len(starts), np.int8)
    for s, e in spans:
        if e > s:
            a, b = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))
            if a >= b or starts[a] != s or ends[b - 1] != e or (starts[a + 1 : b] > ends[a : b - 1]).any():
                raise ValueError(f"tokens don't cover {s}..{e} exactly")
            mask[a:b] = 1
    return mask


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The characters under the mask: a text for every run of masked tokens."""
    on = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
    return [text[starts[a] : ends[b - 1]] for a, b in zip(on[::2].tolist(), on[1::2].tolist())]


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    library_threads()
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    made.post_processor = None  # offsets are not trimmed
    return made


def encoded(tokenizer, rendered: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, starts and ends of the tokens of each list of pieces, as places in the joined text."""
    out = []
    for pieces, e in zip(rendered, tokenizer.encode_batch(rendered, is_pretokenized=True, add_special_tokens=False)):
        at = np.cumsum([0, *map(len, pieces)])[np.array(e.word_ids, np.int64)] if len(e) else np.empty(0, np.int64)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2) + at[:, None]  # a piece's offsets begin at 0
        out.append((np.array(e.ids, np.int32), offsets[:, 0].astype(np.int32), offsets[:, 1].astype(np.int32)))
    return out


def format_conversations(df: DataFrame, tokenizer_path: str | None = None, learn: str = "assistant", segment_chars: int = 1 << 20) -> DataFrame:
    """conv_id, turn, role, text -> a row per conversation (per segment of a run of its turns, in order of part and segment):
    formatted text, token ids, their places in it, and the mask over tokens."""
    path = tokenizer_path or vocabulary_path("byte_bpe_50k.json")
    arrow = to_arrow_schema(T.StructType.fromDDL(SEGMENTS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        ready: list[tuple] = []

        def out() -> pa.RecordBatch:
            rendered = [render(r[3], learn) for r in ready]
            rows = []
            for r, (pieces, spans), (ids, starts, ends) in zip(ready, rendered, encoded(tokenizer, [p for p, _ in rendered])):
                rows.append((*r[:3], "".join(pieces), ids, starts, ends, align(starts, ends, spans)))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        now, segment, turns, held, waiting = None, 0, [], 0, 0
        for batch in batches:
            for conv, part, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if turns and ((conv, part) != now or held > segment_chars):
                    ready.append((*now, segment, turns))
                    segment, turns, held = (segment + 1 if (conv, part) == now else 0), [], 0
                now = conv, part
                turns.append((role, text))
                held += len(text or "") + 16
                waiting += len(text or "") + 16
                if waiting > (1 << 20) and ready:
                    yield out()
                    waiting = held
        if turns:
            ready.append((*now, segment, turns))
        if ready:
            yield out()

    part = F.floor(F.col("turn") / PART_TURNS).alias("part")
    rows = df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.select("conv_id", part, "turn", "role", "text").repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.mapInArrow(run, SEGMENTS)


_READ = "conv_id bigint, part bigint, segment int, n_turns bigint, turns binary, loss binary, loss_chars bigint, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"


def read_back(segments: DataFrame) -> DataFrame:
    """What each segment of the formatted output holds: its turns, parsed from the formatted text, and the text under its
    mask, cut by the masked tokens' places and unescaped."""
    arrow = to_arrow_schema(T.StructType.fromDDL(_READ))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[4:]]
            for k, (conv, part, segment, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                starts, ends, mask = (v[o[k] : o[k + 1]] for o, v in lists)
                turns = parse(text)
                learnt = "".join(map(unescape, masked_texts(text, starts, ends, mask)))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, part, segment, len(turns), said.encode("utf-8", "surrogatepass"), learnt.encode("utf-8", "surrogatepass"), len(learnt), len(text), len(mask), int(mask.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return segments.select("conv_id", "part", "segment", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(run, _READ)


def digests(segments: DataFrame) -> DataFrame:
    """Read the formatted output back, a row per conversation, hashed from segment to segment."""
    arrow = to_arrow_schema(T.StructType.fromDDL(_DIGESTS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            rows = []
            for conv, n, turns, loss, chars, length, tokens, masked in zip(*(batch.column(k).to_pylist() for k in (0, *range(3, 10)))):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[0] += n
                state[1].update(turns)
                state[2] += chars
                state[3].update(loss)
                state[4] += length
                state[5] += tokens
                state[6] += masked
            yield batch_of(rows)
        if state is not None:
            yield batch_of([row()])

    ordered = read_back(segments).repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return ordered.mapInArrow(run, _DIGESTS)


HOSTILE = "\\### Assistant: </turn> ok"


def op3_chat_masks(spark, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    made = format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    return digests(made).drop("n_tokens", "loss_tokens")  # what SQL can't tell

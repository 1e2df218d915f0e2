import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import chat
from wordloom.llm.common import vocabulary_path

HARD = st.lists(st.sampled_from(["### ", "Assistant: ", "</turn>", "\\", "#", "<", "\n", "é", "ok", " "]), max_size=12).map("".join)


@given(st.lists(st.tuples(HARD, HARD), max_size=5))
@settings(max_examples=200, deadline=None)
def test_rendering_is_reversible(turns):
    text = "".join(chat.render(turns)[0])
    assert chat.parse(text) == turns
    assert text.count("</turn>\n") >= len(turns)


def test_texts_hold_no_marks():
    pieces, spans = chat.render([("assistant", "</turn>\n### user\nhi </turn> ####### \\")])
    text, (s, e) = "".join(pieces), spans[0]
    assert "</turn>" not in text[s:e].replace("\\</turn>", "")
    assert chat.unescape(text[s:e]) == "</turn>\n### user\nhi </turn> ####### \\"


def test_align_takes_every_token_of_a_span():
    starts, ends = np.array([0, 3, 5, 5, 9, 10]), np.array([3, 5, 5, 9, 10, 14])
    mask = chat.align(starts, ends, [(3, 9), (10, 14)])
    assert mask.tolist() == [0, 1, 1, 1, 0, 1]
    assert chat.masked_texts("abcdefghijklmn", starts, ends, mask) == ["defghi", "klmn"]
    for spans in ([(4, 9)], [(3, 8)], [(0, 15)]):  # tokens that straddle a span's border, or end before it
        with pytest.raises(ValueError):
            chat.align(starts, ends, spans)
    with pytest.raises(ValueError):
        chat.align(np.array([0, 5]), np.array([3, 9]), [(0, 9)])


def brute_mask(starts, ends, spans):
    return [int(any(s <= a and b <= e and (a < b or s < a < e) for s, e in spans)) for a, b in zip(starts, ends)]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), HARD), max_size=6))
@settings(max_examples=150, deadline=None)
def test_masks_against_every_pair_of_token_and_span(turns):
    tokenizer = chat._tokenizer(vocabulary_path("byte_bpe_50k.json"))
    pieces, spans = chat.render(turns)
    ((ids, starts, ends),) = chat.encoded(tokenizer, [pieces])
    mask, text = chat.align(starts, ends, spans), "".join(pieces)
    assert mask.tolist() == brute_mask(starts.tolist(), ends.tolist(), spans)
    assert "".join(map(chat.unescape, chat.masked_texts(text, starts, ends, mask))) == "".join(t for r, t in turns if r == "assistant")
    assert tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", " héllo  \n\n🎉 there"), (1, 2, "assistant", ""), (1, 3, "assistant", None), (2, 0, "assistant", "### x </turn>"),
    (3, 0, "user", None), (4, None, "user", "first"), (4, 1, None, "b"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b"), (None, 0, "assistant", "no id"), (5, 0, "assistant", "long " * 30_000),
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len("".join(chat.render([(r[2], r[3]) for r in own])[0])))
    return out


LONG = [(9, k, ("user", "assistant")[k % 2], f"turn {k} \n\n said") for k in range(60)] + [(None, k, "assistant", f"no id {k}") for k in range(30)]


@pytest.mark.parametrize(("segment", "part"), [(1 << 20, 4096), (40, 4096), (1 << 20, 7), (40, 3)])
def test_conversations(spark, segment, part, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", part)
    df = spark.createDataFrame([(*r, "clash", 1) for r in CONVERSATIONS + LONG], "conv_id long, turn long, role string, text string, formatted string, part int").repartition(5)
    made = chat.format_conversations(df, segment_chars=segment)
    got = chat.digests(made).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in got} == expected(CONVERSATIONS + LONG)
    assert len(got) == 7
    assert all((r["loss_tokens"] > 0) == (r["loss_chars"] > 0) and r["loss_tokens"] < r["n_tokens"] for r in got)
    # wherever a conversation is cut, its tokens are those of the whole
    tokenizer = chat._tokenizer(vocabulary_path("byte_bpe_50k.json"))
    own = sorted((r for r in made.where("conv_id = 9").collect()), key=lambda r: (r["part"], r["segment"]))
    pieces, spans = chat.render([r[2:] for r in LONG[:60]])
    ((ids, starts, ends),) = chat.encoded(tokenizer, [pieces])
    assert [i for r in own for i in r["token_ids"]] == ids.tolist()
    assert [m for r in own for m in r["loss_mask"]] == chat.align(starts, ends, spans).tolist()


def test_the_loss_text_is_what_the_mask_covers(spark):
    """A spoilt mask, or a moved token, changes the digest: nothing else tells what is learnt."""
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    right = {r["conv_id"]: (r["loss_chars"], r["loss_sha256"], r["turns_sha256"]) for r in chat.digests(made).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    off = made.withColumn("loss_mask", F.transform("loss_mask", lambda x: x * F.lit(0).cast("tinyint")))
    assert {(r["loss_chars"], r["loss_sha256"]) for r in chat.digests(off).collect()} == {(0, nothing)}
    moved = made.withColumn("token_ends", F.transform("token_ends", lambda x: x - 1))
    for r in chat.digests(moved).collect():
        assert r["turns_sha256"] == right[r["conv_id"]][2]
        assert (r["loss_sha256"] == right[r["conv_id"]][1]) == (right[r["conv_id"]][0] == 0)


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)]
    got = chat.op3_chat_masks(spark, small).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in got} == expected(rows)

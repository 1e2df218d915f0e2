from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tests_brute import brute
from wordloom.llm import mixing, quality, toxicity
from wordloom.llm.common import vocabulary_path

FOLDER = "/root/testdata/sf0.01"
EDGE = [(90_000, None, None, None, None), (90_001, "", "en", "src0", 0), (90_002, "x y z " * 20_000, "en", None, 9), (90_003, "one two three four five six seven", "en", "src1", 1), (90_003, "one two three four five six seven", "en", "src1", 1), (None, "a text without an id", "en", "src1", 1)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(EDGE, docs.schema))
    out = {}
    for name, stage in cp.STAGES:
        path = str(folder / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_names_and_columns(stages):
    assert list(stages) == ["toxicity", "quality", "near_copies", "mix", "sentencepiece"]
    for name, (before, after) in stages.items():
        if name != "sentencepiece":
            assert after.columns == before.columns


@pytest.mark.parametrize(("name", "op", "keep"), [("toxicity", toxicity, lambda s: s < 0.5), ("quality", quality, lambda s: s >= 0.3)])
def test_filters_keep_what_their_scores_say(spark, stages, name, op, keep):
    before, after = stages[name]
    model = op.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    texts = before.collect()
    scores = model.score([r["text"] for r in texts], model.words()) if op is toxicity else model.attend([r["text"] for r in texts], quality.word_table())[0]
    assert Counter(tuple(r) for r, s in zip(texts, scores) if keep(s)) == Counter(rows(after))
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    column, good = ("toxic", 0) if op is toxicity else ("quality", 1)
    clean = [r["doc_id"] for r in texts if r["doc_id"] in known and known[r["doc_id"]][column] == good]
    kept = {r["doc_id"] for r in after.collect()}
    assert sum(i in kept for i in clean) > 0.97 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_copies"]
    docs = before.collect()
    known = [r for r in docs if r["doc_id"] is not None]
    least = {i: c for i, _, c in brute([(r["doc_id"], r["text"]) for r in known], 5, 80)}
    want = {(r["doc_id"], r["text"]) for r in known if least[r["doc_id"]] == r["doc_id"]} | {(None, r["text"]) for r in docs if r["doc_id"] is None}
    got = [(r["doc_id"], r["text"]) for r in after.collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_near_copies_are_judged_by_row(spark):
    words = [f"w{k}" for k in range(200)]
    text = lambda a, b: " ".join(words[a:b])
    made = [
        (1, text(0, 60)), (5, text(0, 60)), (5, text(100, 160)),  # a repeated id: one text is a copy, the other is not
        (7, "a b c d e f g h i j " * 9 + "k"), (7, "a b c d e f g h i j " * 9 + "k l"),  # near copies under one id
        (None, "p q r s t u v"), (None, "p q r s t u v"), (None, ""), (8, ""), (8, ""),
        (20, text(60, 98)), (None, text(60, 98) + " a1 a2 a3 a4"), (3, text(60, 98) + " a1 a2 a3 a4 a5 a6 a7 a8 a9"),  # a chain through a null id
    ]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in cp.drop_near_copies(spark, docs, FOLDER).collect())
    seven = {t for i, t in got if i == 7}
    assert len(seven) == 1
    assert got == Counter([(1, made[0][1]), (5, made[2][1]), (7, seven.pop()), (None, "p q r s t u v"), (None, ""), (8, ""), (3, made[12][1])])


def test_mix_follows_the_targets(spark, stages):
    before, after = stages["mix"]
    base = mixing.sized(before)
    ids = {r["__row"]: r["doc_id"] for r in base.collect()}
    want = Counter({ids[r["__row"]]: r["copies"] for r in mixing.copies_of(base).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in after.collect()) == want
    assert max(want.values()) <= 3


def test_encoding(stages):
    judge = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    before, after = stages["sentencepiece"]
    want = Counter((r["doc_id"], tuple(judge.encode(r["text"]))) for r in before.collect())
    assert Counter((r["doc_id"], tuple(r["piece_ids"])) for r in after.collect()) == want


def test_run_and_empty(spark, tmp_path, stages):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_whose_names_clash(spark):
    """What the stages might call their own columns comes out as it went in."""
    extra = ["__score", "__row", "__copies", "__copy", "copies", "__id", "__decided", "__of", "__in", "n", "first", "name", "size", "block"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(150)
    docs = docs.unionByName(spark.createDataFrame(EDGE, docs.schema))
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for name, stage in cp.STAGES[:4]:
        plain, got = stage(spark, docs, FOLDER), stage(spark, wide, FOLDER)
        assert got.columns == wide.columns, name
        rows_ = got.collect()
        assert Counter(tuple(r)[:5] for r in rows_) == Counter(rows(plain)), name
        assert all(r[c] == (f"{c} of {r['doc_id']}" if r["doc_id"] is not None else None) for r in rows_ for c in extra), name
    encoded = cp.encode(spark, wide, FOLDER)
    assert encoded.columns == ["doc_id", "source", "n_pieces", "piece_ids"] and encoded.count() == wide.count()


def test_a_stage_s_tables_go_when_its_result_is_written(spark):
    import os

    from wordloom import session

    docs = spark.createDataFrame([(i, f"word{i} " * 30, "en", f"s{i % 2}", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    mark = session.written()
    kept = session.materialise(cp.mix(spark, docs, FOLDER))
    paths = [p for _, p in session._written[mark:]]
    session.release(mark)
    assert [os.path.exists(p) for p in paths] == [False] * (len(paths) - 1) + [True] and len(paths) > 3
    assert kept.count() > 0

"""Raw documents to encoded training text: toxic documents go, then poor ones, then near copies; what stays is
mixed to the sources' target weights and encoded.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it; a stage's own tables go
when its result is written. Null and empty texts pass the filters (nothing speaks against them), are copies of
nothing, and go in the mix, which takes no words of them. Very long texts are scored, joined, sized and encoded whole. Of
near copies with the same smallest id the first row stays; repeated rows are copies of each other. An empty table stays
empty through all stages. Extra columns pass through all stages but the last, whatever their names: those that a stage adds for
itself are named so that they clash with none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom import session
from wordloom.llm import mixing, ngram_join, quality, spm, toxicity
from wordloom.llm.common import free, kept_by, numbered, own_columns
from wordloom.session import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), free(docs, "score")
    return toxicity.with_scores(docs, model, name=score).where(F.col(score) < 0.5).select(own_columns(docs))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), free(docs, "score")
    return quality.with_scores(docs, model, name=score).where(F.col(score) >= 0.3).select(own_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8: the row of the smallest (id, row number) of each group stays, null ids last. Rows are
    joined and dropped by their numbers, so rows that share an id, or have none, are judged by their own texts. Rows of
    one id and equal texts without words stay once."""
    rows, row = numbered(docs)
    found = ngram_join.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), n=5, percent=80)
    names = rows.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("name"))
    found = materialise(found.join(names, "doc_id"), rows.count())
    first = F.min(F.struct(F.col("name").isNull().alias("none"), "name", "doc_id"))
    groups = found.groupBy("component_id").agg(first["doc_id"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", "first")
    copies = kept_by(found, "component_id", groups, "inner").where("doc_id != first").select("doc_id")
    wordless = kept_by(rows.select(F.col(row), F.col("text")), row, found.where("n_shingles = 0 and name is not null").select("doc_id", "name"), "inner")
    place = F.row_number().over(W.partitionBy("name", "text").orderBy(row))  # rows of one id and one blank text
    again = wordless.withColumn("place", place).where("place > 1").select(F.col(row).alias("doc_id"))
    return kept_by(rows, row, copies.unionByName(again), "left_anti").select(own_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which the mix takes no words goes; one that it takes several times comes as often."""
    rows, row = numbered(docs)
    many = free(rows, "copies")
    copies = mixing.copies_of(mixing.sized(rows, row)).where("copies > 0").toDF(free(rows, "of"), many)
    met = kept_by(rows, row, copies, "inner").withColumn(free(rows, "copy"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(many))))
    return met.select(own_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = spm.encode_texts(docs.select("doc_id", "source", "text"), keep=False)
    return made.select("doc_id", "source", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("mix", mix), ("sentencepiece", encode)]

#: No SQL expresses the learnt stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = session.written()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            session.release(max(0, before - (k > 0)))  # this stage's own tables, and its input
    return docs

"""Views of the driver's tables as corpora of images, words and classes.

A: an order is an image, its parts' sizes are words, the customer's segment is the class; `sparse`: parts are words and the
customer's nation is the class, which leaves many classes without a word. B: eight consecutive vectors of a label are an image, their
places its positions, the label the class; the first vectors are the words. P: predictions made from vector ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.vectors import wide
from wordloom.operators import vocabulary
from wordloom.session import table

WORDS = 16


def order_words(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_partkey")
    if sparse:
        return lines.withColumnRenamed("l_partkey", "word_id")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("word_id"))
    return lines.join(part, "l_partkey").select("image_id", "word_id")


def order_labels(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey" if sparse else "c_mktsegment").alias("class"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), "o_custkey").join(customers, "o_custkey").select("image_id", "class")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, image_id, local_idx, class, rn, vec."""
    rn = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    x = table(spark, d, "embeddings").withColumn("rn", rn)
    image = F.concat_ws("_", F.col("label").cast("string"), F.floor(F.col("rn") / 8).cast("string"))
    return x.select("vec_id", image.alias("image_id"), (F.col("rn") % 8).cast("int").alias("local_idx"), F.col("label").cast("string").alias("class"), "rn", F.col("embedding").alias("vec"))


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("image_id", "class").distinct()


def seeds(spark: SparkSession, d: str, k: int = WORDS) -> DataFrame:
    """The k vectors of the smallest ids as words."""
    first = table(spark, d, "embeddings").orderBy("vec_id").limit(k)
    return first.select((F.row_number().over(W.orderBy("vec_id")) - 1).alias("word_id"), wide(F.col("embedding")).alias("center"))


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """image_id, local_idx, cluster_id, prob: the nearest word, and the cosine to it, none below 0; rows below 0.05 are noise
    and left out."""
    near = vocabulary.assign(vectors(spark, d), seeds(spark, d), measure="cosine")
    x = near.withColumn("prob", F.greatest(F.lit(0.0), F.round("cosine", 6))).withColumnRenamed("word_id", "cluster_id")
    return x.where("prob >= 0.05").select("image_id", "local_idx", "cluster_id", "prob", "class", "vec_id")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", "label")
    wrong = F.col("vec_id") % 3 == 0
    score = lambda c: ((F.col("vec_id") * (c * 13 + 7)) % 101) / 101.0 + F.when(F.col("label") == c, 0.3).otherwise(0.0)
    proba = F.create_map(*[v for c in range(10) for v in (F.lit(str(c)), score(c))])
    guess = F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("string")
    return x.select((F.col("vec_id") % 4).cast("string").alias("run"), F.col("vec_id").alias("image_id"), F.col("label").cast("string").alias("true_label"), guess.alias("predicted_label"), proba.alias("proba"))


# --- the same in SQL ----------------------------------------------------------------------------------

DENSE = """labels AS (SELECT o_orderkey AS image_id, c_mktsegment AS class FROM orders JOIN customer ON o_custkey = c_custkey),
occ AS (SELECT l_orderkey AS image_id, p_size AS word_id, count(*) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
SPARSE = """labels AS (SELECT o_orderkey AS image_id, c_nationkey AS class FROM orders JOIN customer ON o_custkey = c_custkey),
occ AS (SELECT l_orderkey AS image_id, l_partkey AS word_id, count(*) AS f FROM lineitem GROUP BY ALL)"""
STATS = """cw AS (SELECT class, word_id, sum(f)::BIGINT AS freq, count(*) AS df, sum(f * log2(f)) AS flogf FROM occ JOIN labels USING (image_id) GROUP BY ALL),
cs AS (SELECT c.class, coalesce(n, 0) AS n_images FROM (SELECT DISTINCT class FROM labels) c LEFT JOIN (SELECT class, count(DISTINCT image_id) AS n FROM occ JOIN labels USING (image_id) GROUP BY 1) s USING (class)),
dense AS (SELECT cs.class, w.word_id, cs.n_images, coalesce(freq, 0) AS freq, coalesce(df, 0) AS df, coalesce(flogf, 0) AS flogf FROM cs CROSS JOIN (SELECT DISTINCT word_id FROM cw) w LEFT JOIN cw ON cw.class = cs.class AND cw.word_id = w.word_id)"""
SCORES = """inter AS (SELECT word_id, CASE WHEN count(*) > 1 AND count(*) FILTER (freq > 0) > 1 THEN greatest(0, least(1, (log2(sum(freq)) - sum(CASE WHEN freq > 0 THEN freq * log2(freq) ELSE 0 END) / sum(freq)) / log2(count(*)))) ELSE 0 END AS h_inter FROM dense GROUP BY 1),
ent AS (SELECT *, CASE WHEN n_images > 1 AND df > 1 THEN greatest(0, least(1, (log2(freq) - flogf / freq) / log2(n_images))) ELSE 0 END AS h_intra FROM dense JOIN inter USING (word_id)),
scores AS (SELECT 'GCF' AS strategy, class, word_id, freq::DOUBLE AS score FROM ent UNION ALL SELECT 'ICC', class, word_id, freq * h_intra FROM ent UNION ALL SELECT 'CED', class, word_id, greatest(0, freq * h_intra * (1 - h_inter)) FROM ent)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY strategy, class ORDER BY round(score, 9) DESC, word_id) AS rank FROM scores)"
B = """vecs AS (SELECT vec_id, label::VARCHAR || '_' || ((rn // 8)::BIGINT)::VARCHAR AS image_id, (rn % 8)::INTEGER AS local_idx, label::VARCHAR AS class, rn, vec
 FROM (SELECT vec_id, label, embedding::DOUBLE[] AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings)),
seeds AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS word_id, embedding::DOUBLE[] AS center FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16)),
near AS (SELECT * FROM (SELECT v.*, s.word_id, s.center, row_number() OVER (PARTITION BY vec_id ORDER BY round(pow(list_distance(vec, center), 2), 9), word_id) AS r FROM vecs v CROSS JOIN seeds s) WHERE r = 1),
cosine AS (SELECT * FROM (SELECT v.*, s.word_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(2 - 2 * list_cosine_similarity(vec, center), 9), word_id) AS r FROM vecs v CROSS JOIN seeds s) WHERE r = 1),
assigned AS (SELECT * FROM (SELECT image_id, local_idx, word_id AS cluster_id, greatest(0, round(list_cosine_similarity(vec, center), 6)) AS prob, class, vec_id FROM near) WHERE prob >= 0.05)"""
B_OCC = "labels AS (SELECT DISTINCT image_id, class FROM vecs), occ AS (SELECT image_id, cluster_id AS word_id, count(*) AS f FROM assigned GROUP BY ALL)"
P = """p AS (SELECT (vec_id % 4)::VARCHAR AS run, vec_id AS image_id, label::VARCHAR AS true_label, (CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END)::VARCHAR AS predicted_label FROM embeddings),
proba AS (SELECT (vec_id % 4)::VARCHAR AS run, vec_id AS image_id, label::VARCHAR AS true_label, c::VARCHAR AS label, ((vec_id * (c * 13 + 7)) % 101) / 101.0::DOUBLE + CASE WHEN label = c THEN 0.3 ELSE 0 END AS s FROM embeddings CROSS JOIN range(10) t(c)),
counts AS (SELECT run, label, count(*) FILTER (true_label = label AND predicted_label = label) AS tp, count(*) FILTER (true_label = label) AS nt, count(*) FILTER (predicted_label = label) AS np FROM p JOIN (SELECT DISTINCT true_label AS label FROM p) l ON label IN (true_label, predicted_label) GROUP BY ALL),
ranks AS (SELECT *, rank() OVER (PARTITION BY run, label ORDER BY s) + (count(*) OVER (PARTITION BY run, label, s) - 1) / 2.0 AS r FROM proba),
aucs AS (SELECT run, label, (sum(CASE WHEN true_label = label THEN r ELSE 0 END) - n * (n + 1) / 2.0) / (n * (c - n)) AS auc FROM ranks JOIN (SELECT run, label, count(*) FILTER (true_label = label) AS n, count(*) AS c FROM proba GROUP BY ALL) USING (run, label) GROUP BY run, label, n, c),
accuracy AS (SELECT run, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0 END) AS v FROM p GROUP BY 1),
f1 AS (SELECT run, avg(2.0 * tp / (nt + np)) AS v FROM counts GROUP BY 1),
recall AS (SELECT run, avg(CASE WHEN nt > 0 THEN tp / nt::DOUBLE ELSE 0 END) AS v FROM counts GROUP BY 1),
auc AS (SELECT run, avg(auc) AS v FROM aucs GROUP BY 1)"""

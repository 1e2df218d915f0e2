"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.vectors import l2_normalise
from wordloom.operators import allocation, candidates, classify, cluster, evaluation, positional, selection, stats, vocabulary
from wordloom.plans import corpora as C
from wordloom.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOP = 20


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _r(column: str, places: int = 6):
    return F.round(column, places).alias(column)


# --- corpus A: class statistics, scores, selections ---------------------------------------------------


def _a(spark: SparkSession, d: str, sparse: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    occ = stats.occurrence(C.order_words(spark, d, sparse))
    labels = C.order_labels(spark, d, sparse)
    return occ, labels, stats.densified(stats.class_word(occ, labels), stats.class_size(occ, labels))


@query("flagship_top_words", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED} SELECT strategy, class, word_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def flagship_top_words(spark, d):
    return selection.select_top_n(selection.scores(_a(spark, d)[2]), 10).select("strategy", "class", "word_id", "rank", _r("score"))


@query("occurrence", f"WITH {C.DENSE} SELECT * FROM occ")
def occurrence(spark, d):
    return stats.occurrence(C.order_words(spark, d))


@query("class_word_stats", f"WITH {C.DENSE}, {C.STATS} SELECT class, word_id, freq, df FROM cw")
def class_word_stats(spark, d):
    return stats.class_word(stats.occurrence(C.order_words(spark, d)), C.order_labels(spark, d)).drop("flogf")


@query("class_sizes", f"WITH {C.DENSE}, {C.STATS} SELECT * FROM cs")
def class_sizes(spark, d):
    return stats.class_size(stats.occurrence(C.order_words(spark, d)), C.order_labels(spark, d))


@query("df_rho_out_of_class", f"WITH {C.DENSE}, {C.STATS} SELECT class, word_id, df_out, n_out, round(df_out / greatest(n_out, 1)::DOUBLE, 6) AS rho_out FROM (SELECT class, word_id, (sum(df) OVER w - df)::BIGINT AS df_out, (sum(n_images) OVER w - n_images)::BIGINT AS n_out FROM dense WINDOW w AS (PARTITION BY word_id))")
def df_rho_out_of_class(spark, d):
    return stats.out_of_class(_a(spark, d)[2]).select("class", "word_id", "df_out", "n_out", _r("rho_out"))


@query("classes_containing_word", f"WITH {C.DENSE}, {C.STATS} SELECT word_id, count(*) AS n_classes FROM cw GROUP BY 1")
def classes_containing_word(spark, d):
    occ, labels, _ = _a(spark, d)
    return stats.classes_containing(stats.class_word(occ, labels))


def _scored(name: str):
    @query(f"score_{name.lower()}", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES} SELECT class, word_id, round(score, 6) AS score FROM scores WHERE strategy = '{name}'")
    def run(spark, d):
        return selection.scores(_a(spark, d)[2], [name]).select("class", "word_id", _r("score"))


for _name in ("GCF", "ICC", "CED"):
    _scored(_name)


@query("score_ced_sparse", f"WITH {C.SPARSE}, {C.STATS}, {C.SCORES} SELECT class, word_id, n_images, df, round(score, 6) AS score FROM scores JOIN dense USING (class, word_id) WHERE strategy = 'CED'")
def score_ced_sparse(spark, d):
    """Classes and words that leave many cells empty: zero padding, words of one image or one class."""
    dense = _a(spark, d, sparse=True)[2]
    return selection.scores(dense, ["CED"]).join(dense.select("class", "word_id", "n_images", "df"), ["class", "word_id"]).select("class", "word_id", "n_images", "df", _r("score"))


def _selected(spark, d, n=TOP):
    return selection.select_top_n(selection.scores(_a(spark, d)[2]), n)


@query("select_top_n", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED} SELECT strategy, class, word_id, rank FROM ranked WHERE rank <= {TOP}")
def select_top_n(spark, d):
    return _selected(spark, d).select("strategy", "class", "word_id", "rank")


@query("select_union", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED} SELECT DISTINCT strategy, word_id FROM ranked WHERE rank <= {TOP}")
def select_union(spark, d):
    return selection.union_vocabulary(_selected(spark, d))


@query("select_overlap", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED} SELECT strategy, word_id FROM ranked WHERE rank <= {TOP} AND class = 'BUILDING' INTERSECT SELECT strategy, word_id FROM ranked WHERE rank <= {TOP} AND class = 'MACHINERY'")
def select_overlap(spark, d):
    return selection.overlap(materialise(_selected(spark, d).select("strategy", "class", "word_id")), "BUILDING", "MACHINERY")


_UNION5 = "chosen AS (SELECT DISTINCT word_id FROM ranked WHERE strategy = 'CED' AND rank <= 5)"


@query("masked_histogram_zero", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED}, {_UNION5} SELECT i.image_id, w.word_id, coalesce(f, 0) AS f FROM (SELECT DISTINCT image_id FROM occ) i CROSS JOIN (SELECT DISTINCT word_id FROM occ) w LEFT JOIN (SELECT * FROM occ WHERE word_id IN (SELECT word_id FROM chosen)) o ON o.image_id = i.image_id AND o.word_id = w.word_id")
def masked_histogram_zero(spark, d):
    occ, _, dense = _a(spark, d)
    chosen = selection.select_top_n(selection.scores(dense, ["CED"]), 5)
    return stats.masked_zero(occ, chosen, occ)


@query("masked_histogram_compact", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED}, {_UNION5} SELECT image_id, dim, f FROM occ JOIN (SELECT word_id, (row_number() OVER (ORDER BY word_id) - 1)::INTEGER AS dim FROM chosen) USING (word_id)")
def masked_histogram_compact(spark, d):
    occ, _, dense = _a(spark, d)
    return stats.masked_compact(occ, selection.select_top_n(selection.scores(dense, ["CED"]), 5))


# --- allocation ---------------------------------------------------------------------------------------


def _allocated(total: str, group: str, score: str, source: str, bucket: str = "word_id", name: str = "n") -> str:
    return f"""SELECT *, (base + CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY round(share - base, 9) DESC, {bucket}) <= {total} - sum(base) OVER (PARTITION BY {group}) THEN 1 ELSE 0 END)::BIGINT AS {name} FROM (SELECT *, floor(share) AS base FROM (SELECT *, CASE WHEN sum({score}) OVER (PARTITION BY {group}) > 0 THEN {total} * {score} / sum({score}) OVER (PARTITION BY {group}) ELSE {total} / (count(*) OVER (PARTITION BY {group}))::DOUBLE END AS share FROM {source}))"""


@query("allocate_proportional", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED} SELECT strategy, class, word_id, n FROM ({_allocated('1003', 'strategy, class', 'score', '(SELECT * FROM ranked WHERE rank <= 8)')})")
def allocate_proportional(spark, d):
    return allocation.allocate(_selected(spark, d, 8), ["strategy", "class"], "word_id", "score", F.lit(1003)).select("strategy", "class", "word_id", "n")


@query("allocate_uniform_fallback", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED} SELECT strategy, class, word_id, n FROM ({_allocated('1003', 'strategy, class', 'zero', '(SELECT *, 0.0::DOUBLE AS zero FROM ranked WHERE rank <= 7)')})")
def allocate_uniform_fallback(spark, d):
    x = _selected(spark, d, 7).withColumn("zero", F.lit(0.0))
    return allocation.allocate(x, ["strategy", "class"], "word_id", "zero", F.lit(1003)).select("strategy", "class", "word_id", "n")


@query("cyclic_pick", f"WITH {C.DENSE}, {C.STATS}, {C.SCORES}, {C.RANKED}, m AS (SELECT class, word_id, rank FROM ranked WHERE strategy = 'GCF' AND rank <= 7) SELECT c.class, slot, word_id FROM (SELECT DISTINCT class FROM m) c CROSS JOIN range(30) t(slot) JOIN m ON m.class = c.class AND m.rank = slot % 7 + 1")
def cyclic_pick(spark, d):
    m = materialise(selection.select_top_n(selection.scores(_a(spark, d)[2], ["GCF"]), 7).select("class", "word_id", F.col("rank").alias("member_rank")))
    return allocation.pick_cyclic(m.select("class").distinct().withColumn("n", F.lit(30).cast("bigint")), m, ["class"]).select("class", "slot", "word_id")


# --- corpus B: vectors, candidate pools, positions ----------------------------------------------------

_SEL = "sel AS (SELECT class, word_id AS cluster_id, score FROM ranked WHERE strategy = 'GCF' AND rank <= 4), sizes AS (SELECT cluster_id, count(*) AS cluster_size FROM assigned GROUP BY 1)"
_POOL = f"WITH {C.B}, {C.B_OCC}, {C.STATS}, {C.SCORES}, {C.RANKED}, {_SEL}"
_WEIGHTED = f"""{_POOL}, quota AS (SELECT class, n AS class_total FROM ({_allocated("1001", "z", "one", "(SELECT DISTINCT class, 1.0::DOUBLE AS one, 0 AS z FROM sel)", "class")})),
alloc AS (SELECT class, cluster_id, score, cluster_size, n AS n_allocated, greatest(0, n - cluster_size) AS n_duplicated FROM ({_allocated("class_total", "class", "score", "(SELECT * FROM sel JOIN quota USING (class) JOIN sizes USING (cluster_id))", "cluster_id")})),
members AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY prob DESC, image_id, local_idx) AS r FROM assigned)"""


def _b_selection(spark, d, n=4):
    rows = materialise(C.assignments(spark, d))
    labels = C.vector_labels(spark, d)
    occ = stats.occurrence(rows.withColumnRenamed("cluster_id", "word_id"))
    dense = stats.densified(stats.class_word(occ, labels), stats.class_size(occ, labels))
    return rows, selection.select_top_n(selection.scores(dense, ["GCF"]), n).withColumnRenamed("word_id", "cluster_id")


@query("legacy_pool_audit", f"{_POOL} SELECT cluster_id, selection_count, cluster_size, least(selection_count, cluster_size) AS n_taken FROM (SELECT cluster_id, count(*) AS selection_count FROM sel GROUP BY 1) JOIN sizes USING (cluster_id)")
def legacy_pool_audit(spark, d):
    rows, chosen = _b_selection(spark, d)
    return candidates.legacy_audit(chosen, rows)


@query("legacy_pool_rows", f"{_POOL} SELECT cluster_id, image_id, local_idx FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY prob DESC, image_id, local_idx) AS r FROM assigned) JOIN (SELECT cluster_id, count(*) AS k FROM sel GROUP BY 1) USING (cluster_id) WHERE r <= k")
def legacy_pool_rows(spark, d):
    rows, chosen = _b_selection(spark, d)
    return candidates.legacy_pool(chosen, rows).select("cluster_id", "image_id", "local_idx")


@query("weighted_pool_audit", f"{_WEIGHTED} SELECT class, cluster_id, round(score, 6) AS score, cluster_size, n_allocated, n_duplicated FROM alloc")
def weighted_pool_audit(spark, d):
    rows, chosen = _b_selection(spark, d)
    return candidates.weighted_allocation(chosen, rows, 1001).select("class", "cluster_id", _r("score"), "cluster_size", "n_allocated", "n_duplicated")


@query("weighted_pool_rows", f"{_WEIGHTED} SELECT a.class, a.cluster_id, t.slot, m.image_id, m.local_idx FROM alloc a CROSS JOIN range(1001) t(slot) JOIN members m ON m.cluster_id = a.cluster_id AND m.r = t.slot % a.cluster_size + 1 WHERE t.slot < a.n_allocated")
def weighted_pool_rows(spark, d):
    rows, chosen = _b_selection(spark, d)
    return candidates.weighted_pool(chosen, rows, 1001)


@query("candidate_vectors", f"{_WEIGHTED} SELECT a.class, a.cluster_id, t.slot, v.vec_id, round(v.vec[1], 6) AS first FROM alloc a CROSS JOIN range(1001) t(slot) JOIN members m ON m.cluster_id = a.cluster_id AND m.r = t.slot % a.cluster_size + 1 JOIN vecs v ON v.image_id = m.image_id AND v.local_idx = m.local_idx WHERE t.slot < a.n_allocated")
def candidate_vectors(spark, d):
    rows, chosen = _b_selection(spark, d)
    pool = candidates.weighted_pool(chosen, rows, 1001)
    v = C.vectors(spark, d).select("vec_id", "image_id", "local_idx", "vec")
    return pool.join(v, ["image_id", "local_idx"]).select("class", "cluster_id", "slot", "vec_id", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("l2_normalise", "SELECT vec_id, dim::INTEGER AS dim, round(x / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS v FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(l2_normalise(F.col("embedding"))).alias("dim", "v")).select("vec_id", "dim", _r("v"))


@query("assign_euclidean", f"WITH {C.B} SELECT vec_id, word_id::INTEGER AS word_id FROM near")
def assign_euclidean(spark, d):
    return vocabulary.assign(C.vectors(spark, d), C.seeds(spark, d)).select("vec_id", "word_id")


@query("assign_cosine", f"WITH {C.B} SELECT vec_id, word_id::INTEGER AS word_id FROM cosine")
def assign_cosine(spark, d):
    return vocabulary.assign(C.vectors(spark, d), C.seeds(spark, d), "cosine").select("vec_id", "word_id")


@query("encode_histogram", f"WITH {C.B} SELECT image_id, word_id::INTEGER AS word_id, count(*) AS f FROM near GROUP BY ALL")
def encode_histogram(spark, d):
    return vocabulary.encode(C.vectors(spark, d), C.seeds(spark, d))


@query("histogram_l1", f"WITH {C.B} SELECT image_id, word_id::INTEGER AS word_id, round(count(*) / (sum(count(*)) OVER (PARTITION BY image_id))::DOUBLE, 6) AS share FROM near GROUP BY image_id, word_id")
def histogram_l1(spark, d):
    return stats.l1_normalised(vocabulary.encode(C.vectors(spark, d), C.seeds(spark, d))).select("image_id", "word_id", _r("share"))


def _lloyd_sql(k: int, rounds: int) -> str:
    parts = ["v AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings)", f"c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS word_id, vec AS center FROM (SELECT * FROM v ORDER BY vec_id LIMIT {k}))"]
    near = "(SELECT vec_id, vec, word_id FROM (SELECT v.vec_id, v.vec, c.word_id, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(pow(list_distance(v.vec, c.center), 2), 9), c.word_id) AS r FROM v CROSS JOIN {c} c) WHERE r = 1)"
    for i in range(rounds):
        c = near.format(c=f"c{i}")
        parts.append(f"m{i} AS (SELECT word_id, dim, avg(x) AS x FROM (SELECT word_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM {c}) GROUP BY ALL)")
        parts.append(f"c{i + 1} AS (SELECT c.word_id, coalesce(n.fresh, c.center) AS center FROM c{i} c LEFT JOIN (SELECT word_id, list(x ORDER BY dim) AS fresh FROM m{i} GROUP BY 1) n USING (word_id))")
    return f"WITH {', '.join(parts)} SELECT vec_id, word_id FROM {near.format(c=f'c{rounds}')}"


@query("lloyd_kmeans", _lloyd_sql(8, 3))
def lloyd_kmeans(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    words = vocabulary.lloyd(v, 8, 3)
    return vocabulary.assign(v.select(F.col("id").alias("image_id"), F.lit(0).alias("local_idx"), "vec"), words).select(F.col("image_id").alias("vec_id"), "word_id")


_POS = f"""WITH {C.B}, labels AS (SELECT DISTINCT image_id, class FROM vecs), rows AS (SELECT image_id, local_idx AS position, cluster_id AS word_id, prob, vec_id FROM assigned),
ps AS (SELECT position, class, word_id, count(*) AS freq FROM rows JOIN labels USING (image_id) GROUP BY ALL),
cs AS (SELECT class, count(*) AS n_images FROM (SELECT DISTINCT image_id FROM rows) JOIN labels USING (image_id) GROUP BY 1),
dense AS (SELECT cs.class, w.position, w.word_id, n_images, coalesce(freq, 0) AS freq FROM (SELECT DISTINCT position, word_id FROM ps) w CROSS JOIN cs LEFT JOIN ps ON ps.class = cs.class AND ps.position = w.position AND ps.word_id = w.word_id),
inter AS (SELECT position, word_id, CASE WHEN count(*) > 1 AND count(*) FILTER (freq > 0) > 1 THEN greatest(0, least(1, (log2(sum(freq)) - sum(CASE WHEN freq > 0 THEN freq * log2(freq) ELSE 0 END) / sum(freq)) / log2(count(*)))) ELSE 0 END AS h_inter FROM dense GROUP BY ALL),
ent AS (SELECT *, CASE WHEN n_images > 1 AND freq > 1 THEN greatest(0, least(1, log2(freq) / log2(n_images))) ELSE 0 END AS h_intra FROM dense JOIN inter USING (position, word_id)),
sc AS (SELECT 'GCF' AS strategy, position, class, word_id, freq::DOUBLE AS score FROM ent UNION ALL SELECT 'ICC', position, class, word_id, freq * h_intra FROM ent UNION ALL SELECT 'CED', position, class, word_id, greatest(0, freq * h_intra * (1 - h_inter)) FROM ent),
words AS (SELECT * FROM (SELECT strategy, position, class, word_id, row_number() OVER (PARTITION BY strategy, position, class ORDER BY round(score, 9) DESC, word_id) AS rank FROM sc WHERE round(score, 9) > 0) WHERE rank <= 3),
reps AS (SELECT position, word_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY position, word_id ORDER BY prob DESC, image_id) AS r FROM rows SEMI JOIN words USING (position, word_id)) WHERE r = 1)"""


def _positional(spark, d):
    rows = materialise(C.assignments(spark, d).select("image_id", F.col("local_idx").alias("position"), F.col("cluster_id").alias("word_id"), "prob"))
    return rows, C.vector_labels(spark, d)


@query("position_stats", f"{_POS} SELECT * FROM ps")
def position_stats(spark, d):
    return positional.positional_stats(*_positional(spark, d))


@query("position_bags", f"{_POS} SELECT position, count(*) AS n_rows, count(DISTINCT image_id) AS n_images FROM rows GROUP BY 1")
def position_bags(spark, d):
    return positional.position_bags(_positional(spark, d)[0])


@query("position_words", f"{_POS} SELECT strategy, position, class, rank, word_id FROM words")
def position_words(spark, d):
    return positional.position_words(*_positional(spark, d), 3)


@query("position_representatives", f"{_POS} SELECT position, word_id, image_id FROM reps")
def position_representatives(spark, d):
    rows, labels = _positional(spark, d)
    return positional.representatives(rows, positional.position_words(rows, labels, 3))


@query("synthetic_images", f"{_POS} SELECT g.strategy, g.class, g.j, g.position, w.word_id, r.image_id FROM (SELECT s.strategy, c.class, p.position, t.j FROM (SELECT DISTINCT strategy FROM words) s CROSS JOIN (SELECT DISTINCT class FROM labels) c CROSS JOIN range(8) p(position) CROSS JOIN range(7) t(j)) g LEFT JOIN (SELECT strategy, position, class, count(*) AS n FROM words GROUP BY ALL) z ON z.strategy = g.strategy AND z.position = g.position AND z.class = g.class LEFT JOIN words w ON w.strategy = g.strategy AND w.position = g.position AND w.class = g.class AND w.rank = g.j % z.n + 1 LEFT JOIN reps r ON r.position = w.position AND r.word_id = w.word_id")
def synthetic_images(spark, d):
    rows, labels = _positional(spark, d)
    words = materialise(positional.position_words(rows, labels, 3))
    positions = spark.range(8).select(F.col("id").cast("int").alias("position"))
    return positional.synthetic(words, positional.representatives(rows, words), labels.select("class").distinct(), positions, 7).withColumn("j", F.col("j").cast("bigint")).withColumn("position", F.col("position").cast("bigint"))


@query("position_empty_pairs", f"{_POS} SELECT s.strategy, count(*) FILTER (w.rank IS NULL) AS n_empty FROM (SELECT DISTINCT strategy FROM words) s CROSS JOIN (SELECT DISTINCT class FROM labels) c CROSS JOIN range(8) p(position) LEFT JOIN (SELECT * FROM words WHERE rank = 1) w ON w.strategy = s.strategy AND w.class = c.class AND w.position = p.position GROUP BY 1")
def position_empty_pairs(spark, d):
    rows, labels = _positional(spark, d)
    words = materialise(positional.position_words(rows, labels, 3))
    return positional.empty_pairs(words, labels.select("class").distinct(), spark.range(8).select(F.col("id").cast("int").alias("position")))


@query("noise_filter_remap", "SELECT vec_id, (dense_rank() OVER (ORDER BY raw) - 1)::INTEGER AS cluster_id FROM (SELECT vec_id, (CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label * 3 + 2 END) AS raw FROM embeddings) WHERE raw <> -1")
def noise_filter_remap(spark, d):
    return stats.survivors(_noisy(spark, d)).select("vec_id", "cluster_id")


def _noisy(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label") * 3 + 2).alias("label"))


@query("noise_share", "SELECT count(*) FILTER (vec_id % 5 = 0) AS n_noise, avg(CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE 0 END) AS share FROM embeddings")
def noise_share(spark, d):
    return stats.noise_share(_noisy(spark, d))


@query("pending_outputs", "SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_outputs(spark, d):
    from wordloom.sources.images import pending

    return pending(table(spark, d, "documents").select(F.col("doc_id").alias("image_id")), table(spark, d, "labels").select(F.col("doc_id").alias("image_id")))


# --- splits, classifiers, metrics ---------------------------------------------------------------------


@query("stratified_split", f"WITH q AS (SELECT class, n AS quota FROM ({_allocated('ceil(0.2 * (SELECT count(*) FROM documents))', 'z', 'c', '(SELECT lang AS class, count(*)::DOUBLE AS c, 0 AS z FROM documents GROUP BY 1)', 'class')})) SELECT image_id, class, r <= quota AS is_test FROM (SELECT doc_id AS image_id, lang AS class, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS r FROM documents) JOIN q USING (class)")
def stratified_split(spark, d):
    return evaluation.stratified_split(table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.col("lang").alias("class")))


def _sides(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    return x.where("image_id % 5 != 0"), x.where("image_id % 5 = 0")


_SIDES = "train AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 5 <> 0), test AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 5 = 0)"


@query("knn_predict", f"WITH {_SIDES}, top AS (SELECT * FROM (SELECT t.vec_id AS image_id, t.label AS true_label, r.label AS l, row_number() OVER (PARTITION BY t.vec_id ORDER BY round(pow(list_distance(t.vec, r.vec), 2), 9), r.vec_id) AS k FROM test t CROSS JOIN train r) WHERE k <= 5), votes AS (SELECT image_id, true_label, l, count(*) AS v FROM top GROUP BY ALL) SELECT image_id, true_label, l AS predicted_label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, l) AS k FROM votes) WHERE k = 1")
def knn_predict(spark, d):
    return classify.knn(*_sides(spark, d)).drop("proba")


@query("gaussian_nb_predict", f"WITH {_SIDES}, x AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM train), eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT dim, var_pop(x) AS v FROM x GROUP BY 1)), m AS (SELECT label, dim, avg(x) AS m, var_pop(x) + any_value(e) AS v FROM x CROSS JOIN eps GROUP BY ALL), pr AS (SELECT label, ln(count(*) / (SELECT count(*) FROM train)::DOUBLE) AS p FROM train GROUP BY 1), q AS (SELECT vec_id, label AS t, unnest(vec) AS a, generate_subscripts(vec, 1) AS dim FROM test), s AS (SELECT vec_id, t, m.label, sum(-0.5 * (ln(2 * pi() * v) + (a - m) * (a - m) / v)) + any_value(p) AS s FROM q JOIN m USING (dim) JOIN pr ON pr.label = m.label GROUP BY ALL) SELECT vec_id AS image_id, t AS true_label, label AS predicted_label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS k FROM s) WHERE k = 1")
def gaussian_nb_predict(spark, d):
    return classify.gaussian_nb(*_sides(spark, d)).drop("proba")


def _metric(name: str, view: str):
    @query(f"metric_{view}", f"WITH {C.P} SELECT run, round(v, 6) AS value FROM {view}")
    def run(spark, d):
        return evaluation.METRICS[name](C.predictions(spark, d), ["run"]).select("run", _r("value"))


for _name, _view in (("accuracy", "accuracy"), ("f1_macro", "f1"), ("recall_macro", "recall"), ("auc_macro_ovr", "auc")):
    _metric(_name, _view)


@query("metrics_long", f"WITH {C.P} SELECT run, 'accuracy' AS metric, round(v, 6) AS value FROM accuracy UNION ALL SELECT run, 'f1_macro', round(v, 6) FROM f1 UNION ALL SELECT run, 'recall_macro', round(v, 6) FROM recall UNION ALL SELECT run, 'auc_macro_ovr', round(v, 6) FROM auc")
def metrics_long(spark, d):
    return evaluation.evaluate(C.predictions(spark, d), ["run"]).select("run", "metric", _r("value"))


@query("confusion", f"WITH {C.P} SELECT run, true_label, predicted_label, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, d):
    return evaluation.confusion(C.predictions(spark, d), ["run"])


@query("comparison_table", f"WITH {C.P} SELECT 'vectors' AS dataset, 'approach_' || run AS approach, 'full' AS feature_variant, 'fixed' AS classifier, round(accuracy.v, 6) AS accuracy, round(f1.v, 6) AS f1_macro FROM accuracy JOIN f1 USING (run)")
def comparison_table(spark, d):
    p = materialise(C.predictions(spark, d))
    m = evaluation.evaluate(p, ["run"], ["accuracy", "f1_macro"]).groupBy("run").pivot("metric", ["accuracy", "f1_macro"]).agg(F.round(F.first("value"), 6))
    runs = m.select(F.lit("vectors").alias("dataset"), F.concat(F.lit("approach_"), "run").alias("approach"), F.lit("full").alias("feature_variant"), F.lit("fixed").alias("classifier"), "accuracy", "f1_macro")
    return evaluation.comparison_table(runs)


@query("run_count_by_dataset", "SELECT lang AS dataset, count(DISTINCT source) AS n_runs FROM documents GROUP BY 1")
def run_count_by_dataset(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count_distinct("source").alias("n_runs"))


@query("event_bags", "SELECT user_id AS image_id, event_type AS word_id, count(*) AS f FROM events GROUP BY ALL")
def event_bags(spark, d):
    return stats.occurrence(table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("word_id")))


@query("event_cohort_words", "SELECT (user_id % 3)::VARCHAR AS class, event_type AS word_id, count(*) AS freq, count(DISTINCT user_id) AS df FROM events GROUP BY ALL")
def event_cohort_words(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("word_id"))
    labels = e.select("image_id").distinct().withColumn("class", (F.col("image_id") % 3).cast("string"))
    return stats.class_word(stats.occurrence(e), labels).drop("flogf")


# --- fits by the library: rows only -------------------------------------------------------------------


@query("kmeans_mllib")
def kmeans_mllib(spark, d):
    v = C.vectors(spark, d)
    return vocabulary.encode(v, vocabulary.build_vocabulary(v, 16, max_iter=10, metric="cosine"), "cosine")


@query("hdbscan_clusters")
def hdbscan_clusters(spark, d):
    return cluster.density_clusters(C.vectors(spark, d), 3)


@query("pca_reduce")
def pca_reduce(spark, d):
    return cluster.reduce(C.vectors(spark, d), "pca", 8).select("vec_id", F.posexplode("vec").alias("dim", "v"))


@query("umap_reduce")
def umap_reduce(spark, d):
    return cluster.reduce(C.vectors(spark, d), "umap", 4).select("vec_id", F.posexplode("vec").alias("dim", "v"))


@query("classify_mllib")
def classify_mllib(spark, d):
    train, test = _sides(spark, d)
    out = None
    for name in ("logistic_regression", "decision_tree", "random_forest", "mlp", "svc", "xgboost"):
        one = classify.classify(name, train, test, boosting_rounds=5).select(F.lit(name).alias("classifier"), "image_id", "true_label", "predicted_label")
        out = one if out is None else out.unionByName(one)
    return out

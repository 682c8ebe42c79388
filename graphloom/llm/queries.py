"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import clustering, collocations, jaccard, language_model, mixing, neighbours, packing, quality, repeats, secrets, sharding, sketch, tokens
from graphloom.llm.common import crc_bucket, cut, table, text_batches


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["order"] < len(secrets.BASE_RULES))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [count(r.kind) for r in secrets.BASE_RULES]
    return found.select("doc_id", *kinds, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text_batches(spark)
    features = cut(quality.with_features(docs))  # narrow rows, for the fit and for all scores
    weights, threshold = quality.fit_features(features, quality.training_labels(table(spark, sf_dir, "labels")))
    held_out = (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out")
    return quality.score_features(features, weights, threshold).select("doc_id", held_out, "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.repetition(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:02d}" for i in range(16)]
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), shards)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustering.cluster(table(spark, sf_dir, "embeddings"))
    return clustering.with_inertia(found.withColumnRenamed("id", "vec_id"), centroids)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS g FROM g),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM c JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.gs) + len(b.gs) - n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT g.doc_id, len(gs)::BIGINT AS n_shingles, m.component_id, k.class_id
FROM g JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = g.doc_id
JOIN (SELECT doc_id, CASE WHEN len(gs) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(gs)) END AS class_id FROM g) k ON k.doc_id = g.doc_id
"""


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s, length(found[i]) AS n
      FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {group}) AS held, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d)
      WHERE length(held[i]) >= {least}"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
  coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, o) FILTER (o < {len(secrets.BASE_RULES)}), '') AS base,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(v.e, q.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""


def _round_sql(i: int) -> str:
    return f"""c{i} AS MATERIALIZED (
  SELECT o.c, o.d, CASE WHEN s.n IS NULL THEN o.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END::BIGINT AS x
  FROM c{i - 1} o LEFT JOIN (SELECT a.c, v.d, sum(v.x) AS s, count(*) AS n FROM a{i - 1} a JOIN v USING (r) GROUP BY ALL) s USING (c, d)),
a{i} AS MATERIALIZED ({_nearest_sql(i)})"""


def _nearest_sql(i: int) -> str:
    return f"""SELECT r, min_by(c, (t, c)) AS c, min(t) AS t FROM (SELECT v.r, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS t FROM v JOIN c{i} k USING (d) GROUP BY ALL) GROUP BY r"""


OP11_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, d, floor(64 * x[d])::BIGINT AS x FROM e, range(1, 65) t(d)),
c0 AS MATERIALIZED (SELECT s.c, v.d, v.x FROM (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM e WHERE vec_id IS NOT NULL) s JOIN v USING (r) WHERE s.c < 16),
a0 AS MATERIALIZED ({_nearest_sql(0)}),
{", ".join(_round_sql(i) for i in (1, 2, 3))}
SELECT e.vec_id, a.c::INT AS cluster, a.t AS distance, sum(a.t) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.t) OVER ()::BIGINT AS inertia, h.h AS centroid_sha256
FROM a3 a JOIN e USING (r) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c3 GROUP BY c) h USING (c)
"""


OP12_SQL = r"""
WITH p AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
  SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, array_to_string(x, ' ') AS phrase, len(x) AS m, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS x FROM p, range(1, 6) r(m) WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
s AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(f) AS more FROM c, range(2, 5) a(k), range(1, 5) b(i) WHERE k < m AND i <= m - k + 1 GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE more IS NULL OR 100 * more < 100 * f),
h AS (SELECT d.lang, d.phrase, d.f AS a, n, k, l.f AS l, r.f AS r, (1000::HUGEINT * d.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score FROM d JOIN t USING (lang), range(1, 5) a(k), g l, g r
  WHERE k < d.m AND l.lang = d.lang AND r.lang = d.lang AND l.phrase = array_to_string(ws[:k], ' ') AND r.phrase = array_to_string(ws[k + 1:], ' ')),
w AS (SELECT lang, phrase, a, n, l, r, score FROM h QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM w
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP13_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')) AS ts FROM w)),
m AS (SELECT t, min(doc_id) AS d FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM g JOIN m USING (t), range(13) r(o) WHERE doc_id > d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard_join, op2_lm_scoring, op3_secret_scans, op4_quality_classifier, op5_token_counts, op6_fingerprints, op7_mixing, op8_best_fit_packing, op9_sharding, op10_nearest_neighbours, op11_centroid_clustering, op12_collocations, op13_substring_dedup, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op3_secret_scans": OP3_SQL, "op10_nearest_neighbours": OP10_SQL, "op11_centroid_clustering": OP11_SQL, "op12_collocations": OP12_SQL, "op13_substring_dedup": OP13_SQL}

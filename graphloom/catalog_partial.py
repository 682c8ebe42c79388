"""Queries of rules that other queries hold in part only: truth from patterns, overlap scores, tallies, replicate runs, widths."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import CUSTOMER, NS, ORDER, _runs, graph
from graphloom.catalog_more import SCHEMA, _part_schema
from graphloom.functions.terms import RDF_TYPE
from graphloom.operators import analytics, reshape, schema, scoring, truth
from graphloom.registry import register, table

BLOCKS = ["main", "optional", "minus"]
SHOP = "http://shop/"


@register(f"""WITH o AS (SELECT o_custkey AS q, o_orderkey AS k, ['main', 'optional', 'minus'][o_orderkey % 3 + 1] AS b, o_orderpriority AS p, o_orderstatus AS s FROM orders),
e AS (SELECT q, 'class' AS kind, 'C' || s AS term, NULL AS value_type, NULL AS cls, NULL AS prop, b FROM o WHERE k % 4 = 0 UNION ALL SELECT q, 'property', p, NULL, NULL, NULL, b FROM o WHERE k % 4 > 0
 UNION ALL SELECT q, 'instance', '12:30:0' || k % 7, 'temporal', (SELECT 'C' || min(c.s) FROM o c WHERE c.q = o.q AND c.k % 4 = 0), p, b FROM o WHERE k % 4 = 1
 UNION ALL SELECT q, 'instance', 'http://item/' || k % 5, 'uri', NULL, p, b FROM o WHERE k % 4 = 2
 UNION ALL SELECT q, 'instance', (k % 9)::VARCHAR, 'numeric', CASE WHEN EXISTS (SELECT 1 FROM o c WHERE c.q = o.q AND c.k % 4 = 3) THEN (SELECT 'C' || min(c.s) FROM o c WHERE c.q = o.q AND c.k % 4 = 0) END, (SELECT min(c.p) FROM o c WHERE c.q = o.q AND c.k % 4 = 3), b FROM o WHERE k % 5 = 0)
SELECT q AS question_id, kind, term, coalesce(value_type, '') AS value_type, coalesce(cls, '') AS associated_class, coalesce(prop, '') AS associated_property, CASE WHEN bool_or(b <> 'optional') THEN 'required' ELSE 'acceptable' END AS necessity FROM e GROUP BY ALL""")
def e23_truth_of_patterns(spark, d):
    """A customer's orders are the patterns of a question: a class, a literal, an item or a variable each, in blocks of three kinds."""
    k = F.col("o_orderkey")
    block = F.element_at(F.array(*map(F.lit, BLOCKS)), (k % 3 + 1).cast("int")).alias("block")
    four = lambda *x: F.when(k % 4 == 0, x[0]).when(k % 4 == 1, x[1]).when(k % 4 == 2, x[2]).otherwise(x[3])
    text = lambda n: (k % n).cast("string")
    p = table(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), F.lit(1).alias("reading_id"), block, F.lit("?x").alias("s"),
        F.when(k % 4 == 0, RDF_TYPE).otherwise(F.col("o_orderpriority")).alias("p"),
        four(
            F.concat(F.lit("C"), "o_orderstatus"), F.concat(F.lit("12:30:0"), text(7)), F.concat(F.lit("http://item/"), text(5)),
            F.lit("?y")
        ).alias("o"),
        four(F.lit("iri"), F.lit("literal"), F.lit("iri"), F.lit("variable")).alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"),
    )
    filters = table(spark, d, "orders").where(k % 5 == 0).select(
        F.col("o_custkey").alias("question_id"), F.lit(1).alias("reading_id"), block, F.lit("?y").alias("variable"), F.lit(">").alias("op"),
        text(9).alias("value"), F.lit("literal").alias("value_kind"), F.lit("integer").alias("value_datatype")
    )
    t = truth.retrieval_elements(p, filters, (SHOP,))
    return t.select(
        "question_id", "kind", "term",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("value_type", "associated_class", "associated_property")), "necessity"
    )


@register("""WITH c AS (SELECT DISTINCT (p_partkey % 50)::INT AS pair, p_size % 4 AS col FROM part), v AS (SELECT DISTINCT (p_partkey % 50)::INT AS pair, p_size % 4 AS col, p_brand AS v FROM part WHERE p_partkey % 3 = 0), s AS (SELECT DISTINCT (p_partkey % 50)::INT AS pair, p_size % 3 AS col, p_brand AS v FROM part WHERE p_partkey % 5 = 0),
h AS (SELECT DISTINCT pair, v.col FROM v WHERE (pair, v) IN (SELECT pair, v FROM s)), k AS (SELECT c.pair, CASE WHEN col = 3 THEN 'own' ELSE 'shared' || col % 2 END AS concept, max((h.col IS NOT NULL)::INT) AS hit FROM c LEFT JOIN h USING (pair, col) WHERE col > 0 GROUP BY 1, 2),
m AS (SELECT pair, count(DISTINCT col) AS n, count(DISTINCT col) FILTER ((pair, v) IN (SELECT pair, v FROM v)) AS matched FROM s GROUP BY 1)
SELECT p.pair, round(coalesce((SELECT avg(hit) FROM k WHERE k.pair = p.pair), 1), 6) AS schema_recall, round(coalesce(matched / n, 0), 6) AS schema_precision FROM (SELECT DISTINCT pair FROM c) p LEFT JOIN m USING (pair)""")
def e16_schema_overlap(spark, d):
    """Sizes modulo 4 are expected columns, all but the first preferred; sizes modulo 3 are found columns; brands are values."""
    p = table(spark, d, "part").withColumn("pair", (F.col("p_partkey") % 50).cast("int"))
    col = (F.col("p_size") % 4).cast("string")
    columns = p.select("pair", col.alias("col")).distinct().withColumn("level", F.when(F.col("col") == "0", "acceptable").otherwise("preferred")).withColumn(
        "concept", F.when(F.col("col") == "3", "").otherwise(F.concat(F.lit("shared"), (F.col("col").cast("int") % 2).cast("string")))
    )
    gt = p.where("p_partkey % 3 = 0").select("pair", col.alias("col"), F.col("p_brand").alias("value"))
    found = p.where("p_partkey % 5 = 0").select("pair", (F.col("p_size") % 3).cast("string").alias("col"), F.col("p_brand").alias("value"))
    t = scoring.score_schema_overlap(columns, gt, found)
    return t.select("pair", *(F.round(c, 6).alias(c) for c in ("schema_recall", "schema_precision")))


@register(
    """SELECT o_orderpriority AS purpose, count(*) AS n, count(*) FILTER (k = 0) AS correct, count(*) FILTER (k IN (1, 2)) AS incorrect, count(*) FILTER (k IN (3, 4)) AS failed, round(avg((k = 0)::INT), 6) AS accuracy FROM (SELECT *, o_orderkey % 5 AS k FROM orders) GROUP BY 1"""
)
def e30_tallies(spark, d):
    k = F.col("o_orderkey") % 5
    error = F.when(k == 1, "incorrect answer").when(k == 3, "timeout").when(k == 4, "no such table")
    r = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("purpose"), F.when(k < 4, (k == 0).cast("int")).alias("correct"), error.alias("error")
    )
    return scoring.result_tallies(r).withColumn("accuracy", F.round("accuracy", 6))


MEASURED = "(SELECT o_orderstatus AS approach, o_orderpriority AS query_set, ['EDU', 'EDU_LARGE', 'TRN', 'TRN_LARGE'][o_custkey % 4 + 1] AS dataset, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS f1 FROM orders)"


@register(
    f"""SELECT approach, query_set, replace(dataset, '_LARGE', '') AS dataset, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM {MEASURED} GROUP BY GROUPING SETS ((), (approach), (query_set), (replace(dataset, '_LARGE', '')))"""
)
def a19_by_dataset(spark, d):
    names = F.array(*map(F.lit, ["EDU", "EDU_LARGE", "TRN", "TRN_LARGE"]))
    r = _runs(spark, d).select(
        "approach", F.col("condition").alias("query_set"), F.element_at(names, (F.col("question_id") % 4 + 1).cast("int")).alias("dataset"),
        F.when(F.col("run_id") % 5 > 0, (F.col("run_id") % 11) / 10.0).alias("f1")
    )
    t = analytics.retrieval_summary(r, ["f1"])
    return t.select("approach", "query_set", "dataset", "n", F.round("mean_f1", 6).alias("mean_f1"), F.round("std_f1", 6).alias("std_f1"))


@register("""SELECT o_custkey AS question_id, o_orderstatus AS approach, count(*) AS n, round(coalesce(avg(f), 0), 6) AS mean_f1, round(coalesce(stddev_pop(f), 0), 6) AS std_f1, round(avg(o_totalprice), 4) AS mean_time_ms, round(stddev_pop(o_totalprice), 4) AS std_time_ms,
 round(avg((o_orderkey % 3 = 0)::INT), 6) AS success_rate, round(avg((o_orderkey % 7 = 0)::INT), 6) AS unanswerable_rate FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS f FROM orders) GROUP BY 1, 2""")
def a20_batch_stats(spark, d):
    k = F.col("run_id")
    r = _runs(spark, d).select(
        "question_id", "approach", F.when(k % 5 > 0, (k % 11) / 10.0).alias("f1"), F.lit(1.0).alias("accuracy"),
        F.col("score").cast("double").alias("time_ms"), k.alias("tokens"), F.when(k % 3 == 0, True).alias("success"),
        (k % 7 == 0).alias("unanswerable")
    )
    t = analytics.batch_stats(r, ["question_id", "approach"])
    return t.select(
        "question_id", "approach", "n", *(F.round(c, 6).alias(c) for c in ("mean_f1", "std_f1")),
        *(F.round(c, 4).alias(c) for c in ("mean_time_ms", "std_time_ms")),
        *(F.round(c, 6).alias(c) for c in ("success_rate", "unanswerable_rate"))
    )


@register(
    f"SELECT \"range\" AS element, string_agg(DISTINCT class, ',' ORDER BY class) AS referenced_in FROM {SCHEMA} WHERE is_object GROUP BY 1"
)
def g7_references(spark, d):
    e = schema.elements(_part_schema(spark, d)).where("referenced_in IS NOT NULL")
    return e.select("element", F.array_join("referenced_in", ",").alias("referenced_in"))


@register(f"""WITH o AS (SELECT o_custkey AS query_id, o_orderkey AS k, '?' || o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN '{RDF_TYPE}' WHEN o_orderkey % 3 = 1 THEN '?p' ELSE 'p' END AS p, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '?' || o_orderstatus END AS o FROM orders),
v AS (SELECT query_id, k, s AS variable, 0 AS i, 'subject' AS n, CASE WHEN k % 3 = 0 THEN o END AS c FROM o UNION ALL SELECT query_id, k, p, 1, 'predicate', NULL FROM o WHERE p LIKE '?%' UNION ALL SELECT query_id, k, o, 2, 'object', NULL FROM o WHERE o LIKE '?%')
SELECT query_id, variable, string_agg('pattern_' || k || '_' || n, ' ' ORDER BY k, i) AS positions, coalesce(string_agg(DISTINCT c, ' ' ORDER BY c), '') AS classes FROM v GROUP BY 1, 2""")
def g16_positions(spark, d):
    k, status = F.col("o_orderkey"), F.concat(F.lit("?"), "o_orderstatus")
    p = table(spark, d, "orders").select(
        F.col("o_custkey").alias("query_id"), k.alias("pattern_id"), status.alias("s"),
        F.when(k % 3 == 0, RDF_TYPE).when(k % 3 == 1, "?p").otherwise("p").alias("p"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(status).alias("o")
    )
    return schema.variable_positions(p).select(
        "query_id", "variable", F.array_join("positions", " ").alias("positions"), F.array_join("classes", " ").alias("classes")
    )


@register(
    """SELECT CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 1 THEN 0 ELSE c_nationkey END::INT AS nation, CASE WHEN c_custkey % 3 < 2 THEN '' ELSE c_mktsegment END AS segment FROM customer"""
)
def h9_width(spark, d):
    """Rows of one, two or four values for three columns, with texts like NULL and numbers that are none."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, " null ").otherwise(F.col("c_name"))
    nation = F.when(k % 4 == 1, F.lit("x")).otherwise(F.col("c_nationkey").cast("string"))
    cells = F.when(k % 3 == 0, F.array(name)).when(k % 3 == 1, F.array(name, nation)).otherwise(
        F.array(name, nation, F.col("c_mktsegment"), F.lit("more"))
    )
    return reshape.fit_width(
        table(spark, d, "customer").select(cells.alias("values")), [("name", "string"), ("nation", "int"), ("segment", "string")]
    )


@register("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY 'http://example.org/order/' || o_orderkey) AS l FROM orders), c AS (SELECT c_custkey, row_number() OVER (ORDER BY 'http://example.org/customer/' || c_custkey) AS r FROM customer)
SELECT l AS left_nr, r AS right_nr FROM o JOIN c ON o_custkey = c_custkey""")
def h7_links(spark, d):
    """Orders and their customers by the integer keys of both entity tables."""
    g = graph(spark, d, [CUSTOMER, ORDER], RDF_TYPE, NS + "by", NS + "name", NS + "priority")
    orders = reshape.entities(g, NS + "Order", {NS + "priority": "priority"})
    customers = reshape.entities(g, NS + "Customer", {NS + "name": "name"})
    return reshape.linked_keys(reshape.link_table(g, NS + "by"), orders, customers)

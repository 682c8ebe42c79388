"""Queries of searches, similarity joins, unbound variables, star alternatives and evaluation gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import CUSTOMER, NS, ORDER, _vectors, graph, iri, key
from graphloom.catalog_more import ANCESTORS, PARENTS, _parents, scratch
from graphloom.functions import terms, text
from graphloom.operators import linking, minhash, patterns, schema, scoring, substrings
from graphloom.operators.patterns import natural, scan
from graphloom.plans import mapping as m
from graphloom.plans.stars import MappedGraph
from graphloom.registry import register, table
from graphloom.sources import files

# searches: the terms are the first three letters of every word of the parts' types and names' third word, in capitals
TERMS = "(SELECT DISTINCT upper(substr(w, 1, 3)) AS term FROM (SELECT unnest(string_split(p_type || ' ' || p_name, ' ')) AS w FROM part) WHERE length(w) > 1)"


def _terms(spark, d) -> DataFrame:
    words = table(spark, d, "part").select(
        F.explode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("w")
    ).where(F.length("w") > 1)
    return words.select(F.upper(F.substring("w", 1, 3)).alias("term")).distinct()


@register(f"SELECT term, p_partkey AS element_id FROM part JOIN {TERMS} ON contains(lower(p_name), lower(term))")
def l1_grep_terms(spark, d):
    """All terms at once in the names of all parts."""
    e = table(spark, d, "part").select(F.col("p_partkey").alias("element_id"), F.lit("class").alias("type"), F.col("p_name").alias("text"))
    index = substrings.build_index(e, scratch(spark))
    return linking.grep_terms(e, _terms(spark, d), index).select("term", "element_id")


@register(f"""WITH c AS (SELECT DISTINCT replace(p_type, ' ', '_') AS c FROM part), a AS (SELECT DISTINCT child, ancestor FROM {ANCESTORS})
SELECT c AS element_id, (SELECT count(DISTINCT parent) FROM {PARENTS} p WHERE p.child = c)::INT AS n_parents, (SELECT count(*) FROM a WHERE a.child = c)::INT AS hierarchy_depth,
 (SELECT count(DISTINCT child) FROM {PARENTS} p WHERE p.parent = c)::INT AS n_children FROM c""")
def l1_hierarchy(spark, d):
    found = table(spark, d, "part").select(F.regexp_replace("p_type", " ", "_").alias("element_id")).distinct()
    t = linking.with_hierarchy(found, _parents(spark, d))
    return t.select(
        "element_id", F.size("parent_classes").alias("n_parents"), "hierarchy_depth", F.size("child_classes").alias("n_children")
    )


@register("SELECT DISTINCT c_name AS value FROM customer WHERE regexp_matches(c_name, 'CUSTOMER#.*[37]9$', 'i') ORDER BY 1 LIMIT 500")
def l6_late_values(spark, d):
    """Matches far behind the first 500 names."""
    g = graph(spark, d, [CUSTOMER], terms.RDF_TYPE, NS + "name")
    return linking.grep_values(g, NS + "Customer", NS + "name", "CUSTOMER#.*[37]9$")


@register(
    "SELECT term, value FROM (SELECT '0' || n_nationkey || '1' AS term FROM nation) JOIN (SELECT DISTINCT c_name AS value FROM customer) ON contains(lower(value), lower(term)) QUALIFY row_number() OVER (PARTITION BY term ORDER BY value) <= 20"
)
def l6_value_terms(spark, d):
    g = graph(spark, d, [CUSTOMER], terms.RDF_TYPE, NS + "name")
    asked = table(spark, d, "nation").select(F.concat(F.lit("0"), F.col("n_nationkey").cast("string"), F.lit("1")).alias("term"))
    index = substrings.build_index(g.where("o_kind = 'literal'"), scratch(spark), "o")
    return linking.grep_values_terms(g, NS + "Customer", NS + "name", asked, index, 20)


@register(
    f"SELECT 'shop' AS dataset, term, count(*) AS n, min('http://example.org/customer/' || c_custkey) AS example FROM (SELECT c_custkey, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, c_name FROM customer) JOIN (SELECT term FROM {TERMS} WHERE length(term) = 3 UNION SELECT DISTINCT substr(c_name, 12, 4) FROM customer) t ON contains(lower(v), lower(term)) GROUP BY term"
)
def l22_terms_of_tables(spark, d):
    g = graph(spark, d, [CUSTOMER], NS + "segment", NS + "name").withColumn("dataset", F.lit("shop"))
    asked = _terms(spark, d).union(table(spark, d, "customer").select(F.substring("c_name", 12, 4)))
    return linking.search_instances(g, asked)


GRAMS = "list_distinct(list_transform(range(1, greatest(length(v) - 1, 2)), lambda i: lower(v)[i:i + 2]))"


@register(f"""WITH n AS (SELECT DISTINCT p_name AS v FROM part), g AS (SELECT v, unnest({GRAMS}) AS g, len({GRAMS}) AS k FROM n), j AS (SELECT a.v AS a, b.v AS b, count(*) / (any_value(a.k) + any_value(b.k) - count(*)) AS j FROM g a JOIN g b USING (g) GROUP BY ALL),
r AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY a ORDER BY j DESC, b) <= 10) SELECT count(DISTINCT a) AS keywords, count(*) AS pairs, true AS enough FROM r""")
def l17_recall(spark, d):
    """How many pairs the exact way finds for all names, and whether the bands' ten nearest are at least 0.9 of them as near."""
    values = table(spark, d, "part").select(F.col("p_name").alias("value")).distinct()
    keywords = values.withColumnRenamed("value", "keyword")
    exact = minhash.exact_similar_values(values, keywords)
    worst = exact.groupBy("keyword").agg(F.min("jaccard").alias("worst"), F.count(F.lit(1)).alias("n"))
    found = minhash.similar_values(values, keywords, exact=True).join(worst, "keyword").groupBy("keyword").agg(
        F.count_if(F.col("jaccard") >= F.col("worst") - 1e-12).alias("right")
    )
    t = worst.join(found, "keyword", "left").agg(
        F.count(F.lit(1)).alias("keywords"), F.sum("n").alias("pairs"), F.sum(F.coalesce("right", F.lit(0))).alias("right")
    )
    return t.select("keywords", "pairs", (F.col("right") >= 0.9 * F.col("pairs")).alias("enough"))


@register("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 > 0) SELECT q.vec_id AS query_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.v, q.v), 12) DESC, e.vec_id)::INT AS rank
 FROM e q JOIN e ON q.vec_id % 100 = 0 QUALIFY rank <= 5""")
def l3_vectors_with_nulls(spark, d):
    """Every seventh vector is null or holds a null."""
    queries, items, _ = _vectors(spark, d)
    holes = lambda df, k: df.withColumn(
        "v",
        F.when(F.col(k) % 14 == 0, F.lit(None)).when(
            F.col(k) % 7 == 0, F.transform("v", lambda x, i: F.when(i > 0, x))
        ).otherwise(F.col("v"))
    )
    return linking.vector_topk(holes(queries, "query_id"), holes(items, "item_id"), 5).select("query_id", "item_id", "rank")


# unbound variables
@register("""WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 5 > 0 OR o_orderkey % 3 = 0 THEN o_orderkey % 10 END AS x FROM orders),
r AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 10 END AS x, c_name AS v FROM customer WHERE c_nationkey < 3)
SELECT l.k, coalesce(l.c, r.c)::VARCHAR AS c, coalesce(l.x, r.x)::VARCHAR AS x, v FROM l LEFT JOIN r ON (l.c = r.c OR l.c IS NULL) AND (l.x = r.x OR l.x IS NULL OR r.x IS NULL)""")
def p5_optional_masks(spark, d):
    """Orders without a customer or a digit, customers without a digit; one of both is always bound on the left."""
    k, text = F.col("o_orderkey"), lambda x: x.cast("string")
    # texts before the join, as a row meets many others
    left = table(spark, d, "orders").select(
        k.alias("k"), F.when(k % 3 > 0, text(F.col("o_custkey"))).alias("c"), F.when((k % 5 > 0) | (k % 3 == 0), text(k % 10)).alias("x")
    )
    c = F.col("c_custkey")
    right = table(spark, d, "customer").where("c_nationkey < 3").select(
        text(c).alias("c"), F.when(c % 4 > 0, text(c % 10)).alias("x"), F.col("c_name").alias("v")
    )
    return patterns.optional(left, right, ("c", "x"), ("x",))


@register("""WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 10 END AS x FROM orders),
r AS (SELECT DISTINCT CASE WHEN c_custkey % 2 > 0 THEN c_custkey END AS c, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 10 END AS x FROM customer WHERE c_nationkey = 7 AND c_custkey % 7 < 5 AND c_custkey % 10 <> 6)
SELECT k, c::VARCHAR AS c, x::VARCHAR AS x FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE (l.c = r.c OR l.c IS NULL OR r.c IS NULL) AND (l.x = r.x OR l.x IS NULL OR r.x IS NULL) AND (l.c = r.c OR l.x = r.x))""")
def p7_minus_unbound(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    left = table(spark, d, "orders").select(
        k.alias("k"), F.when(k % 3 > 0, F.col("o_custkey")).alias("c"), F.when(k % 5 > 0, k % 10).alias("x")
    )
    some = table(spark, d, "customer").where("c_nationkey = 7 AND c_custkey % 7 < 5 AND c_custkey % 10 <> 6")
    right = some.select(F.when(c % 2 > 0, c).alias("c"), F.when(c % 4 > 0, c % 10).alias("x"))
    kept = patterns.minus(left, right, ("c", "x"), ("c", "x"))
    return kept.select("k", F.col("c").cast("string").alias("c"), F.col("x").cast("string").alias("x"))


# stars over a map with two objects of one predicate and two classes
CALLED = m.TriplesMap(
    "customer", iri("customer", "c_custkey"), (NS + "Customer", NS + "Party"),
    (m.obj_col(NS + "called", "c_name"), m.obj_col(NS + "called", "c_mktsegment"))
)
MAKER = m.TriplesMap("supplier", iri("supplier", "s_suppkey"), (NS + "Supplier",), (m.obj_col(NS + "called", "s_name"),))


@register(
    "SELECT 'c' || c_custkey AS k, unnest([c_name, c_mktsegment]) AS v FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier"
)
def p2_two_objects(spark, d):
    found = MappedGraph([CALLED, MAKER], _tables(spark, d)).solve([("?x", NS + "called", "?v")]).bindings()
    return found.select(_short("x").alias("k"), "v")


@register(
    f"SELECT 'c' || c_custkey AS k, c_mktsegment AS v, unnest(['{NS}Customer', '{NS}Party']) AS class FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'c' || c_custkey, c_name, unnest(['{NS}Customer', '{NS}Party']) FROM customer WHERE c_mktsegment = 'BUILDING'"
)
def p2_two_classes(spark, d):
    asked = [("?x", NS + "called", "BUILDING"), ("?x", NS + "called", "?v"), ("?x", terms.RDF_TYPE, "?class")]
    found = MappedGraph([CALLED, MAKER], _tables(spark, d)).solve(asked).bindings()
    return found.select(_short("x").alias("k"), "v", "class")


def _tables(spark, d) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("customer", "supplier", "orders")}


def _short(var: str):
    return F.concat(F.substring(F.element_at(F.split(var, "/"), -2), 1, 1), F.element_at(F.split(var, "/"), -1))


@register("SELECT o_orderkey::BIGINT AS k, o_orderpriority AS priority, o_custkey::BIGINT AS c FROM orders")
def s7_star_on_disk(spark, d):
    """Two patterns of one subject on the bucketed store, joined without a shuffle."""
    stored = files.write_triples(graph(spark, d, [ORDER], NS + "priority", NS + "by"), scratch(spark))
    met = natural(scan(stored, "?o", NS + "priority", "?priority"), scan(stored, "?o", NS + "by", "?c"))
    return met.select(key("o").alias("k"), "priority", key("c").alias("c"))


# schema: properties of part types whose ranges are part types
LINKS = "(SELECT DISTINCT replace(a.p_type, ' ', '_') AS class, 'near' || (a.p_partkey % 3) AS property, replace(b.p_type, ' ', '_') AS \"range\" FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@register(f"""WITH s AS {LINKS}, anc AS (SELECT DISTINCT child, ancestor FROM {ANCESTORS}), present AS (SELECT DISTINCT class FROM s), many AS (SELECT ancestor FROM anc JOIN present ON class = child GROUP BY 1 HAVING count(DISTINCT child) >= 2),
up AS (SELECT child, min(parent) AS up FROM {PARENTS} JOIN many ON ancestor = parent GROUP BY 1)
SELECT DISTINCT a.ancestor AS class, property, coalesce(up, "range") AS "range", true AS is_object FROM s JOIN anc a ON a.child = s.class LEFT JOIN up ON up.child = s."range" WHERE a.ancestor NOT IN (FROM present)""")
def g2_lifted_ranges(spark, d):
    p = table(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("k"), F.regexp_replace("p_type", " ", "_").alias("range"))
    s = p.join(b, F.col("p_partkey") == F.col("k")).select(
        F.regexp_replace("p_type", " ", "_").alias("class"),
        F.concat(F.lit("near"), (F.col("p_partkey") % 3).cast("string")).alias("property"), "range", F.lit(True).alias("is_object")
    ).distinct()
    return schema.lift_schema(s, _parents(spark, d))


# normal forms
@register(
    """SELECT p_partkey AS k, lower(p_name) AS v, 'http://n/' || p_partkey || '~%2A-%20' || replace(p_name, ' ', '%20') AS iri FROM part"""
)
def n1_m6_edges(spark, d):
    """Names within tabs, line feeds and no-break spaces; IRIs of names with a tilde and an asterisk."""
    p = table(spark, d, "part").withColumn("x", F.concat(F.col("p_partkey").cast("string"), F.lit("~*- "), "p_name"))
    ends = F.element_at(F.array(*map(F.lit, ["\t", "\n", "  ", "\x1c ", "\r\n"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("k"), text.norm_text(F.concat(ends, "p_name", ends), nfc=True).alias("v"),
        terms.from_template("http://n/{x}").alias("iri")
    )


# evaluation
@register("""WITH g AS (SELECT DISTINCT p_brand AS pair, p_partkey AS row FROM part WHERE p_partkey % 2 = 0), s AS (SELECT DISTINCT p_brand AS pair, p_partkey AS row FROM part WHERE p_partkey % 3 > 0),
t AS (SELECT pair, count(*) FILTER (g.row IS NOT NULL AND s.row IS NOT NULL) AS tp, count(s.row) AS n, count(g.row) AS m FROM g FULL JOIN s USING (pair, row) GROUP BY 1)
SELECT pair, tp, round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6) AS precision, round(tp / m, 6) AS recall FROM t WHERE m > 0""")
def e5_without_scores(spark, d):
    """No expected row has a score, so rows are compared exactly."""
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("pair"), F.array(F.col("p_partkey").cast("string")).alias("row"), F.lit(None).cast("double").alias("score"),
        "p_partkey", "p_size"
    )
    found = scoring.score_topn(
        p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 > 0").withColumn("score", F.col("p_size").cast("double"))
    )
    return found.select("pair", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("""WITH o AS (SELECT o_custkey % 60 AS run, o_orderkey AS k, 'c' || o_custkey AS a, o_orderpriority AS b FROM orders), g AS (SELECT DISTINCT run, a, b FROM o WHERE k % 2 = 0), s AS (SELECT DISTINCT run, a, b FROM o WHERE k % 3 = 0 AND run % 4 = 0),
x AS (SELECT DISTINCT run, a FROM o WHERE k % 3 = 0 AND run % 4 = 1), ga AS (SELECT DISTINCT run, a FROM g),
t AS (SELECT run, count(*) FILTER (g.a IS NOT NULL AND s.a IS NOT NULL) AS tp, count(g.a) AS m, count(s.a) AS n FROM g FULL JOIN s USING (run, a, b) WHERE run % 4 = 0 GROUP BY run UNION ALL
 SELECT run, count(*) FILTER (ga.a IS NOT NULL AND x.a IS NOT NULL), count(ga.run) FILTER (ga.a IS NOT NULL), count(x.run) FILTER (x.a IS NOT NULL) FROM ga FULL JOIN x USING (run, a) WHERE run % 4 = 1 GROUP BY run)
SELECT run::INT AS run_id, round(CASE WHEN tp > 0 THEN 2 * tp / (m + n) ELSE 0 END, 6) AS data_f1, (CASE WHEN tp > 0 THEN 1 ELSE 0 END)::DOUBLE AS schema_recall FROM t UNION ALL SELECT DISTINCT run::INT, 0, 0 FROM g WHERE run % 4 > 1""")
def e18_levels(spark, d):
    """Runs find both columns, the preferred one, only the acceptable one, or nothing; the last two find no part of the answer."""
    k, run = F.col("o_orderkey"), (F.col("o_custkey") % 60).cast("int")
    o = table(spark, d, "orders").select(
        F.struct(run.alias("run_id"), F.lit(1).alias("reading_id")).alias("pair"), run.alias("run"), k.alias("row_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.col("o_orderpriority").alias("b")
    )
    cells = lambda df, *names: df.select("pair", "row_id", *(c.alias(n) for n, c in names)).unpivot(
        ["pair", "row_id"], [n for n, _ in names], "col", "value"
    )
    gt = cells(o.where("row_id % 2 = 0"), ("customer", F.col("a")), ("priority", F.col("b")))
    own = o.where("row_id % 3 = 0")
    found = cells(own.where("run % 4 = 0"), ("x", F.col("a")), ("y", F.col("b")))
    found = found.unionByName(
        cells(own.where("run % 4 = 1"), ("x", F.col("a")))
    ).unionByName(cells(own.where("run % 4 = 2"), ("y", F.col("b"))))
    kinds = [("customer", "preferred"), ("priority", "acceptable")]
    columns = gt.select("pair").distinct().select(
        "pair",
        F.explode(
            F.array(
                *(F.struct(F.lit(c).alias("col"), F.lit(n).alias("level"), F.lit(c).alias("concept"), F.lit(False).alias("is_label")) for c, n in kinds)
            )
        ).alias("x")
    ).select("pair", "x.*")
    t = scoring.evaluate(gt, found, columns)
    return t.select("run_id", F.round("data_f1", 6).alias("data_f1"), "schema_recall")


# column signatures: a query for each brand and type of parts asks for its properties
SIGNED = """(SELECT DISTINCT p_brand || '_' || p_type AS q, 'size' || (p_size % 7) AS p FROM part)"""


def _signatures(spark, d) -> DataFrame:
    t = table(spark, d, "part").select(
        F.concat_ws("_", "p_brand", "p_type").alias("query_id"), F.concat(F.lit("size"), (F.col("p_size") % 7).cast("string")).alias("p")
    ).distinct()
    asked = t.select("query_id", F.lit("?x").alias("s"), "p", F.lit("?y").alias("o")).unionByName(
        t.select("query_id", F.lit("?x").alias("s"), F.lit(terms.RDF_TYPE).alias("p"), F.col("query_id").alias("o")).distinct()
    )
    shown = t.select("query_id").distinct().select(
        "query_id", F.lit("?y").alias("variable"), F.lit(None).cast("string").alias("agg"), F.array().cast("array<string>").alias("inner"),
        F.lit(None).cast("string").alias("nested")
    )
    return scoring.signatures(asked, shown)


@register(
    f"SELECT q AS query_id, string_agg(p, ',' ORDER BY p) AS in_predicates, string_agg('out:' || p, ',' ORDER BY p) || ',type:' || q AS subject_context FROM {SIGNED} GROUP BY q"
)
def e20_signatures(spark, d):
    return _signatures(spark, d).select(
        "query_id", F.array_join("in_predicates", ",").alias("in_predicates"), F.array_join("subject_context", ",").alias("subject_context")
    )


@register(f"""WITH s AS (SELECT q, list(DISTINCT p) AS ps FROM {SIGNED} GROUP BY q), p AS (SELECT a.q AS a, b.q AS b, len(list_intersect(a.ps, b.ps)) AS i, len(a.ps) + len(b.ps) AS n FROM s a JOIN s b ON split_part(a.q, '_', 1) = split_part(b.q, '_', 1) AND a.q < b.q)
SELECT a, b, round((i / (n - i)) * (0.7 + 0.3 * (i / (n + 2 - i))), 6) AS sim FROM p""")
def e21_signature_sim(spark, d):
    """Signatures of the types of one brand; their contexts differ in the class."""
    s = _signatures(spark, d).withColumn("first", F.split("query_id", "_")[0])
    side = lambda n: s.select(*(F.col(c).alias(f"{n}_{c}") for c in s.columns))
    pairs = side("a").join(side("b"), (F.col("a_first") == F.col("b_first")) & (F.col("a_query_id") < F.col("b_query_id")))
    return scoring.signature_sim(pairs).select(
        F.col("a_query_id").alias("a"), F.col("b_query_id").alias("b"), F.round("sim", 6).alias("sim")
    )


from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import terms, text
from graphloom.operators import analytics, linking, patterns, reshape, schema, scoring
from graphloom.operators.patterns import bgp, group, natural, number, optional, scan, typed
from graphloom.plans import mapping as m
from graphloom.plans.stars import MappedGraph, Solutions
from graphloom.registry import QUERIES, SQL, Query, register, table
from graphloom.sources import files
from graphloom.streaming import traces

NS = "http://example.org/shop#"


class _Tables(dict):
    """The tables of a folder, read when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table(self.spark, self.sf_dir, name)
        return self[name]


def iri(kind: str, column: str) -> str:
    return f"http://example.org/{kind}/{{{column}}}"


REGION = m.TriplesMap("region", iri("region", "r_regionkey"), (NS + "Region",), (m.obj_col(NS + "name", "r_name"),))
NATION = m.TriplesMap(
    "nation", iri("nation", "n_nationkey"), (NS + "Nation",),
    (m.obj_col(NS + "name", "n_name", lang="en"), m.ref(NS + "inRegion", REGION, "n_regionkey", "r_regionkey"))
)
CUSTOMER = m.TriplesMap(
    "customer", iri("customer", "c_custkey"), (NS + "Customer",),
    (m.obj_col(NS + "name", "c_name"), m.obj_col(NS + "segment", "c_mktsegment"), m.obj_tpl(NS + "inNation", iri("nation", "c_nationkey")))
)
SUPPLIER = m.TriplesMap(
    "supplier", iri("supplier", "s_suppkey"), (NS + "Supplier",),
    (m.obj_col(NS + "name", "s_name"), m.obj_tpl(NS + "inNation", iri("nation", "s_nationkey")), m.obj_tpl(NS + "label", "{s_name} ({s_suppkey})", literal=True))
)
PART = m.TriplesMap(
    "part", iri("part", "p_partkey"), (NS + "Part",),
    (m.obj_col(NS + "name", "p_name"), m.obj_col(NS + "size", "p_size", "integer"), m.obj_col(NS + "brand", "p_brand"), m.const(NS + "status", "active", literal=True))
)
ORDER = m.TriplesMap(
    "orders", iri("order", "o_orderkey"), (NS + "Order",),
    (m.obj_tpl(NS + "by", iri("customer", "o_custkey")), m.obj_col(NS + "priority", "o_orderpriority"))
)
LINE = m.TriplesMap(
    lambda t: t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("qty")),
    "http://example.org/line/{l_orderkey}-{l_linenumber}", (NS + "LineItem",),
    (m.obj_tpl(NS + "part", iri("part", "l_partkey")), m.obj_tpl(NS + "order", iri("order", "l_orderkey")), m.obj_col(NS + "quantity", "qty", "integer"))
)
#: Part types as classes, and a view of joined tables.
TYPED_PART = m.TriplesMap(
    lambda t: t["part"].select("p_partkey", F.regexp_replace("p_type", " ", "_").alias("cls")), iri("part", "p_partkey"), (),
    (m.obj_tpl(terms.RDF_TYPE, NS + "{cls}"),)
)
ASIAN = m.TriplesMap(
    lambda t: t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(
        t["region"].where("r_name like '%ASIA%' and r_name is not null"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("c_custkey", F.col("n_name").alias("country")).distinct(),
    iri("customer", "c_custkey"), (NS + "AsianCustomer",), (m.obj_col(NS + "country", "country"),)
)
SHOP = [REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER]


def graph(spark: SparkSession, sf_dir: str, maps: list[m.TriplesMap], *predicates: str) -> DataFrame:
    """The triples of some predicates (all if none are named), not deduplicated: the tables' keys are unique."""
    t = _Tables(spark, sf_dir)
    if not predicates:
        return m.triples(maps, t)
    out = m.triples(maps, t, predicates[0])
    for p in predicates[1:]:
        out = out.unionByName(m.triples(maps, t, p))
    return out


def mapped(spark: SparkSession, sf_dir: str, *maps: m.TriplesMap) -> MappedGraph:
    return MappedGraph(list(maps), _Tables(spark, sf_dir))


def key(col: str):
    """The number at the end of an IRI."""
    return F.regexp_extract(col, r"(\d+)$", 1).cast("long")


I = "'http://example.org/"


# sources and sinks
@register(
    "SELECT 'nation' AS result_id, n_nationkey::VARCHAR AS row_id, 'n_name' AS col, n_name AS value FROM nation UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'n_regionkey', n_regionkey::VARCHAR FROM nation"
)
def s6_cells(spark, d):
    df = table(spark, d, "nation").select(
        F.lit("nation").alias("rid"), F.col("n_nationkey").cast("string").alias("k"), "n_name", "n_regionkey"
    )
    return files.to_cells(df, "rid", "k")


@register(
    "SELECT o_orderkey, 'high' AS source_run FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey, 'low' FROM orders WHERE o_orderpriority LIKE '5%'"
)
def s9_snapshot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return files.build_snapshot(
        {"high": o.where("o_orderpriority like '1%'").drop("o_orderpriority"), "low": o.where("o_orderpriority like '5%'").drop("o_orderpriority")}
    )


# mapping
@register(
    f"SELECT {I}nation/' || n_nationkey AS s, '{NS}inRegion' AS p, {I}region/' || r_regionkey AS o FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def m15_reference(spark, d):
    return m.triples([NATION], _Tables(spark, d), NS + "inRegion").select("s", "p", "o")


@register(
    f"SELECT {I}customer/' || c_custkey AS s, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%ASIA%'"
)
def m3_joined_view(spark, d):
    return m.triples([ASIAN], _Tables(spark, d), NS + "country").select("s", "o")


@register(f"""SELECT p, count(*) AS n FROM (SELECT '{terms.RDF_TYPE}' AS p FROM region UNION ALL SELECT '{terms.RDF_TYPE}' FROM nation UNION ALL SELECT '{terms.RDF_TYPE}' FROM part
 UNION ALL SELECT '{NS}name' FROM region UNION ALL SELECT '{NS}name' FROM nation UNION ALL SELECT '{NS}name' FROM part UNION ALL SELECT '{NS}inRegion' FROM nation
 UNION ALL SELECT '{NS}size' FROM part UNION ALL SELECT '{NS}brand' FROM part UNION ALL SELECT '{NS}status' FROM part) GROUP BY p""")
def m16_materialize(spark, d):
    return patterns.predicate_counts(m.materialize([REGION, NATION, PART], _Tables(spark, d)))


@register(f"SELECT {I}part/' || p_partkey AS s, '{NS}' || replace(p_type, ' ', '_') AS o FROM part")
def m14_type_from_column(spark, d):
    return m.triples([TYPED_PART], _Tables(spark, d), terms.RDF_TYPE).select("s", "o")


@register(f"SELECT {I}supplier/' || s_suppkey AS s, s_name || ' (' || s_suppkey || ')' AS o, 'literal' AS o_kind FROM supplier")
def m10_literal_template(spark, d):
    return m.triples([SUPPLIER], _Tables(spark, d), NS + "label").select("s", "o", "o_kind")


def type_edges(spark, d) -> DataFrame:
    t = table(spark, d, "part").select("p_type").distinct()
    cls = F.concat(F.lit(NS), F.regexp_replace("p_type", " ", "_"))
    first, whole = F.concat(F.lit(NS), F.element_at(F.split("p_type", " "), 1), F.lit("_Part")), F.lit(NS + "Part")
    return t.select(cls.alias("child"), first.alias("parent")).union(t.select(first, whole)).distinct()


EDGES = f"(SELECT DISTINCT '{NS}' || replace(p_type, ' ', '_') AS child, '{NS}' || split_part(p_type, ' ', 1) || '_Part' AS parent FROM part UNION SELECT DISTINCT '{NS}' || split_part(p_type, ' ', 1) || '_Part', '{NS}Part' FROM part)"


@register(
    f"SELECT o AS class, count(*) AS n FROM (SELECT p_partkey, '{NS}' || replace(p_type, ' ', '_') AS o FROM part UNION SELECT p_partkey, '{NS}' || split_part(p_type, ' ', 1) || '_Part' FROM part UNION SELECT p_partkey, '{NS}Part' FROM part) GROUP BY o"
)
def m18_entailed_types(spark, d):
    return patterns.class_counts(
        m.entail_types(m.triples([TYPED_PART], _Tables(spark, d)), schema.closure(type_edges(spark, d)).select("child", "ancestor"))
    )


@register(
    "SELECT 'http://example.org/order/{o_custkey}' AS template, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_iris, 0::BIGINT AS collisions FROM orders"
)
def m20_audit(spark, d):
    return m.audit_templates([m.TriplesMap("orders", iri("order", "o_custkey"))], _Tables(spark, d))


@register(
    f"SELECT DISTINCT {I}region/' || r_regionkey AS s, CASE WHEN k = 1 THEN '{terms.RDF_TYPE}' ELSE 'urn:label' END AS p, CASE WHEN k = 1 THEN 'http://other.org/Region' ELSE r_name END AS o FROM region, (VALUES (1), (2)) v(k)"
)
def m21_renamed(spark, d):
    renames = spark.createDataFrame([(NS + "name", "urn:label")], "old string, new string")
    return m.rename_terms(graph(spark, d, [REGION]), renames, {NS: "http://other.org/"}).select("s", "p", "o")


@register("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def m22_local_values(spark, d):
    return scan(
        graph(spark, d, [NATION], NS + "name"), "?s", NS + "name", "?name"
    ).select(terms.local_value(F.col("s")).cast("long").alias("k"), "name")


# patterns
@register("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def p2_pattern_join(spark, d):
    g = mapped(spark, d, REGION, NATION)
    return g.solve(
        [("?n", NS + "inRegion", "?r"), ("?n", NS + "name", "?nation"), ("?r", NS + "name", "?region")]
    ).bindings("nation", "region")


@register("SELECT c_custkey::BIGINT AS k, o_orderkey::BIGINT AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def p4_optional(spark, d):
    g = mapped(spark, d, CUSTOMER, ORDER)
    found = g.solve([("?c", terms.RDF_TYPE, NS + "Customer")]).join(g.solve([("?o", NS + "by", "?c")]), "left")
    return found.bindings("c", "o").select(key("c").alias("k"), key("o").alias("o"))


@register("SELECT s_name AS supplier, NULL::VARCHAR AS customer FROM supplier UNION ALL SELECT NULL, c_name FROM customer")
def p6_union(spark, d):
    g = graph(spark, d, [CUSTOMER, SUPPLIER], terms.RDF_TYPE, NS + "name")
    one = natural(typed(g, "?x", NS + "Supplier"), scan(g, "?x", NS + "name", "?supplier"))
    two = natural(typed(g, "?x", NS + "Customer"), scan(g, "?x", NS + "name", "?customer"))
    return patterns.union(one.drop("x"), two.drop("x"))


@register("SELECT c_custkey::BIGINT AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def p7_minus(spark, d):
    g = graph(spark, d, [CUSTOMER, ORDER], terms.RDF_TYPE, NS + "by")
    return patterns.minus(typed(g, "?c", NS + "Customer"), scan(g, "?o", NS + "by", "?c")).select(key("c").alias("k"))


@register("SELECT p_partkey::BIGINT AS k, p_size::VARCHAR AS size FROM part WHERE p_size >= 40")
def p8_numeric_filter(spark, d):
    return patterns.where_num(
        scan(graph(spark, d, [PART], NS + "size"), "?x", NS + "size", "?size"), "size", ">=", 40
    ).select(key("x").alias("k"), "size")


@register("SELECT o_orderkey::BIGINT AS k FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
def p9_lexical_range(spark, d):
    return patterns.where_lexical(
        scan(graph(spark, d, [ORDER], NS + "priority"), "?x", NS + "priority", "?v"), "v", "2", "4"
    ).select(key("x").alias("k"))


@register("SELECT c_custkey::BIGINT AS k FROM customer WHERE regexp_matches(c_mktsegment, 'build|auto', 'i')")
def p11_regex(spark, d):
    return patterns.where_regex(
        scan(graph(spark, d, [CUSTOMER], NS + "segment"), "?x", NS + "segment", "?v"), "v", "build|auto", "i"
    ).select(key("x").alias("k"))


@register("SELECT DISTINCT p_size::VARCHAR AS o, 'http://www.w3.org/2001/XMLSchema#integer' AS datatype FROM part")
def p13_datatype(spark, d):
    return patterns.datatype_of(graph(spark, d, [PART], NS + "size"), NS + "size").select("o", "datatype").distinct()


@register("SELECT c_mktsegment AS v, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1 HAVING count(*) > 5")
def p17_group_having(spark, d):
    found = mapped(spark, d, CUSTOMER).solve([("?x", NS + "segment", "?v"), ("?x", NS + "inNation", "?n")])
    rows = group(found.df, found.keys("v"), n=F.count(F.lit(1)), nations=F.count_distinct(*found.keys("n"))).where("n > 5")
    return rows.select(found.text("v").alias("v"), "n", "nations")


@register("SELECT p_brand AS brand, sum(p_size)::DOUBLE AS total, avg(p_size) AS mean, min(p_size)::DOUBLE AS low FROM part GROUP BY 1")
def p18_numbers(spark, d):
    rows = mapped(spark, d, PART).solve([("?x", NS + "brand", "?brand"), ("?x", NS + "size", "?v")]).bindings("brand", "v")
    return group(rows, ["brand"], total=F.sum(number("v")), mean=F.avg(number("v")), low=F.min(number("v")))


@register(
    "SELECT r_name AS region, string_agg(n_name, '; ' ORDER BY n_name) AS nations, min(n_name) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
)
def p20_group_concat(spark, d):
    return group(p2_pattern_join(spark, d), ["region"], nations=patterns.group_concat("nation", "; ", True), one=patterns.sample("nation"))


@register(
    "SELECT c AS k, avg(n) AS mean, sum(n)::BIGINT AS total FROM (SELECT c_mktsegment AS c, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1"
)
def p21_two_levels(spark, d):
    found = mapped(spark, d, CUSTOMER, ORDER).solve([("?o", NS + "by", "?c"), ("?c", NS + "segment", "?s")])
    inner = group(found.df, [*found.keys("c"), *found.keys("s")], n=F.count(F.lit(1)))
    return group(inner.select(found.text("s").alias("k"), "n"), ["k"], mean=F.avg("n"), total=F.sum("n"))


@register(
    "SELECT p_partkey::BIGINT AS k, p_name AS name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY n DESC, k LIMIT 10"
)
def p24_top_parts(spark, d):
    # a line's part and order are one projection of its table; parts are counted and named by their keys
    g = mapped(spark, d, PART, LINE)
    lines = g.solve([("?l", NS + "part", "?p"), ("?l", NS + "order", "?o")])
    counted = group(lines.df, lines.keys("p"), n=F.count_distinct(*lines.keys("o")))
    best = patterns.top(counted.withColumn("k", key(lines.text("p"))), 10, F.desc("n"), "k")
    named = Solutions(best, {"p": lines.terms["p"]}).join(g.solve([("?p", NS + "name", "?name")]), "left")
    return named.df.select("k", named.text("name").alias("name"), "n")


@register("SELECT count(*) > 0 AS answer FROM part WHERE p_size > 1000")
def p27_ask(spark, d):
    return patterns.ask(patterns.where_num(scan(graph(spark, d, [PART], NS + "size"), "?x", NS + "size", "?v"), "v", ">", 1000))


@register("SELECT DISTINCT 'a' AS dataset, n_name AS name FROM nation UNION SELECT DISTINCT 'b', r_name FROM region")
def p28_federated(spark, d):
    return patterns.federate(
        lambda g: scan(g, "?x", NS + "name", "?name").select("name"),
        {"a": graph(spark, d, [NATION], NS + "name"), "b": graph(spark, d, [REGION], NS + "name")}
    )


@register(
    "SELECT class, n FROM (SELECT '" + NS + "Region' AS class, count(*) AS n FROM region UNION ALL SELECT '" + NS + "Nation', count(*) FROM nation UNION ALL SELECT '" + NS + "Part', count(*) FROM part)"
)
def p31_class_counts(spark, d):
    return patterns.class_counts(graph(spark, d, [REGION, NATION, PART], terms.RDF_TYPE))


# schema
@register(f"""SELECT * FROM (VALUES ('{NS}Region', '{NS}name', '{terms.XSD}string', false), ('{NS}Nation', '{NS}name', '{terms.XSD}string', false), ('{NS}Nation', '{NS}inRegion', '{NS}Region', true),
 ('{NS}Part', '{NS}name', '{terms.XSD}string', false), ('{NS}Part', '{NS}size', '{terms.XSD}integer', false), ('{NS}Part', '{NS}brand', '{terms.XSD}string', false), ('{NS}Part', '{NS}status', '{terms.XSD}string', false)) v(class, property, "range", is_object) WHERE (SELECT count(*) FROM part) > 0""")
def g1_extract_schema(spark, d):
    return schema.extract_schema(graph(spark, d, [REGION, NATION, PART]))


@register(
    f"WITH RECURSIVE e AS {EDGES}, c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.child, e.parent, depth + 1 FROM c JOIN e ON c.ancestor = e.child) SELECT child, ancestor, min(depth)::INT AS depth FROM c GROUP BY 1, 2"
)
def g3_closure(spark, d):
    return schema.closure(type_edges(spark, d))


def shop_schema(spark, d) -> DataFrame:
    return schema.cut(schema.extract_schema(graph(spark, d, SHOP)))


@register(
    f"""SELECT p AS property, string_agg(DISTINCT c, ',' ORDER BY c) AS domains, string_agg(DISTINCT r, ',' ORDER BY r) AS ranges, bool_or(o) AS is_object FROM (SELECT '{NS}Region' AS c, '{NS}name' AS p, '{terms.XSD}string' AS r, false AS o FROM region UNION SELECT '{NS}Nation' AS c, '{NS}name' AS p, '{terms.XSD}string' AS r, false AS o FROM nation UNION SELECT '{NS}Nation' AS c, '{NS}inRegion' AS p, '{NS}Region' AS r, true AS o FROM nation UNION SELECT '{NS}Customer' AS c, '{NS}name' AS p, '{terms.XSD}string' AS r, false AS o FROM customer UNION SELECT '{NS}Customer' AS c, '{NS}segment' AS p, '{terms.XSD}string' AS r, false AS o FROM customer UNION SELECT '{NS}Customer' AS c, '{NS}inNation' AS p, '{NS}Nation' AS r, true AS o FROM customer UNION SELECT '{NS}Supplier' AS c, '{NS}name' AS p, '{terms.XSD}string' AS r, false AS o FROM supplier UNION SELECT '{NS}Supplier' AS c, '{NS}inNation' AS p, '{NS}Nation' AS r, true AS o FROM supplier UNION SELECT '{NS}Supplier' AS c, '{NS}label' AS p, '{terms.XSD}string' AS r, false AS o FROM supplier UNION SELECT '{NS}Part' AS c, '{NS}name' AS p, '{terms.XSD}string' AS r, false AS o FROM part UNION SELECT '{NS}Part' AS c, '{NS}size' AS p, '{terms.XSD}integer' AS r, false AS o FROM part UNION SELECT '{NS}Part' AS c, '{NS}brand' AS p, '{terms.XSD}string' AS r, false AS o FROM part UNION SELECT '{NS}Part' AS c, '{NS}status' AS p, '{terms.XSD}string' AS r, false AS o FROM part UNION SELECT '{NS}Order' AS c, '{NS}by' AS p, '{NS}Customer' AS r, true AS o FROM orders UNION SELECT '{NS}Order' AS c, '{NS}priority' AS p, '{terms.XSD}string' AS r, false AS o FROM orders) GROUP BY 1"""
)
def g4_views(spark, d):
    return schema.schema_views(shop_schema(spark, d)).select(
        "property", F.array_join("domains", ",").alias("domains"), F.array_join("ranges", ",").alias("ranges"), "is_object"
    )


@register(
    f"SELECT * FROM (VALUES ('{NS}Order', '{NS}Region', 3, '{NS}Order>{NS}Customer>{NS}Nation>{NS}Region')) v(a, b, hops, path) WHERE (SELECT count(*) FROM orders) > 0"
)
def g9_shortest_path(spark, d):
    g = schema.connection_graph(shop_schema(spark, d), spark.createDataFrame([], "child string, parent string"))
    pairs = spark.createDataFrame([(NS + "Order", NS + "Region")], "a string, b string")
    return schema.shortest_paths(g, pairs).select("a", "b", "hops", F.array_join("path", ">").alias("path"))


@register(
    "SELECT o_custkey::BIGINT AS node, o_custkey::BIGINT AS component FROM orders GROUP BY 1 UNION ALL SELECT 1000000000 + o_orderkey, o_custkey FROM orders"
)
def g10_components(spark, d):
    """All customers with their orders, each a component by the customer."""
    return schema.components(
        table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") + 1_000_000_000).alias("b"))
    )


@register("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT o_custkey::BIGINT AS a, 1000000 + l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), w AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM w UNION SELECT w.b, min(cc.component) FROM cc JOIN w ON w.a = cc.node JOIN recurring.cc AS k ON k.node = w.b WHERE cc.component < k.component GROUP BY w.b)
SELECT node, component FROM cc""")
def g10_components_all(spark, d):
    """All customers and suppliers."""
    l = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return schema.components(l.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")))


@register(f"SELECT property FROM (VALUES ('{NS}nmae'), ('{NS}colour')) v(property) WHERE (SELECT count(*) FROM region) > 0")
def g11_unknown_terms(spark, d):
    p = spark.createDataFrame(
        [("?x", terms.RDF_TYPE, NS + "Region"), ("?x", NS + "name", "?n"), ("?x", NS + "nmae", "?n"), ("?x", NS + "colour", "?n")],
        "s string, p string, o string"
    )
    found = schema.validate(p, schema.extract_schema(graph(spark, d, [REGION])), spark.createDataFrame([], "child string, ancestor string"))
    return found.where("issue = 'unknown property'").select(F.col("p").alias("property"))


@register(f"SELECT '{NS}nmae' AS term, '{NS}name' AS suggestion, 2 AS distance, 1 AS rank FROM region LIMIT 1")
def g14_suggestions(spark, d):
    known = shop_schema(spark, d).select(F.col("property").alias("term")).distinct()
    return schema.suggest(spark.createDataFrame([(NS + "nmae",)], "term string"), known, 2, 1)


@register(
    f"SELECT * FROM (VALUES ('{NS}Region', 'only_datatype'), ('{NS}Nation', 'both'), ('{NS}Part', 'only_datatype')) v(class, kind) WHERE (SELECT count(*) FROM part) > 0"
)
def g15_property_kinds(spark, d):
    return schema.property_kind(schema.extract_schema(graph(spark, d, [REGION, NATION, PART])))


# linking
@register("SELECT DISTINCT p_type AS element_id FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_type), 'ste')")
def l1_grep(spark, d):
    e = table(spark, d, "part").select(F.col("p_type").alias("element_id"), F.lit("property").alias("type"), F.col("p_type").alias("text"))
    return linking.grep(e, "STE", "property").select("element_id")


@register("""SELECT query_id, item_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id)::INT AS rank
 FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0) WHERE rank <= 10""")
def l3_vector_topk(spark, d):
    queries, items, _ = _vectors(spark, d)
    return linking.vector_topk(queries, items, 10).select("query_id", "item_id", "rank")


@register("""SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS t FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
 FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0) WHERE rank <= 30 AND label = 1) WHERE t <= 10""")
def l4_typed_topk(spark, d):
    queries, items, types = _vectors(spark, d)
    near = linking.vector_topk_typed(queries, items, types, 1, 10)
    return near.select("query_id", "item_id")


RANKED = "(SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0)"


def _vectors(spark, d):
    """Every hundredth vector as a query, and all vectors."""
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")
    ), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("type"))


@register(f"SELECT query_id, item_id, rank::INT AS rank FROM {RANKED} WHERE rank <= 10")
def l3_vector_topk_hundredth(spark, d):
    queries, items, _ = _vectors(spark, d)
    return linking.vector_topk(queries, items, 10).select("query_id", "item_id", "rank")


@register(
    f"SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS t FROM {RANKED} WHERE rank <= 30 AND label = 1) WHERE t <= 10"
)
def l4_typed_topk_hundredth(spark, d):
    queries, items, types = _vectors(spark, d)
    return linking.vector_topk_typed(queries, items, types, 1, 10).select("query_id", "item_id")


@register("SELECT DISTINCT c_mktsegment AS value FROM customer ORDER BY 1 LIMIT 3")
def l5_property_values(spark, d):
    return linking.property_values(graph(spark, d, [CUSTOMER], terms.RDF_TYPE, NS + "segment"), NS + "Customer", NS + "segment", 3)


@register("SELECT min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, (max(p_size) - min(p_size))::DOUBLE AS spread FROM part")
def l8_profile(spark, d):
    return linking.profile_property(graph(spark, d, [PART], NS + "size"), NS + "size").select("low", "high", "spread")


HITS = "(SELECT 1 AS query_id, source AS doc, doc_id AS hit_id, ((doc_id * 37) % 101) / 100.0::DOUBLE AS distance FROM documents)"


@register(f"""WITH h AS {HITS}, a AS (SELECT *, row_number() OVER (ORDER BY distance, hit_id) AS r FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY distance, hit_id) AS i FROM a WHERE r <= 50),
 g AS (SELECT doc, count(*) AS k, avg(distance) FILTER (i <= 2) AS s FROM n GROUP BY doc HAVING count(*) >= 2) SELECT doc, hit_id FROM n JOIN g USING (doc) WHERE s <= (SELECT min(s) FROM g) * 1.5""")
def l10_rank_documents(spark, d):
    hits = table(spark, d, "documents").select(
        F.lit(1).alias("query_id"), F.col("source").alias("doc"), F.col("doc_id").alias("hit_id"),
        (((F.col("doc_id") * 37) % 101) / 100.0).alias("distance")
    )
    return linking.rank_documents(hits, 50, 2, 2, 0.5).select("doc", "hit_id")


@register(
    """SELECT doc, used FROM (SELECT source AS q, doc_id AS doc, sum(n_chars) OVER w AS used, max((CASE WHEN u > 20000 THEN 1 ELSE 0 END)) OVER w AS o FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS u FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE o = 0"""
)
def l11_token_budget(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("doc"), F.col("doc_id").alias("score"), F.col("n_chars").alias("size")
    )
    return linking.token_budget(docs, 20_000).select("doc", F.col("used").cast("decimal(38,0)").cast("double").alias("used"))


@register()
def l17_lsh_values(spark, d):
    """All names of parts, for every name."""
    values = table(spark, d, "part").select(F.col("p_name").alias("value")).distinct()
    return linking.lsh_values(values, values.withColumnRenamed("value", "keyword"))


# scoring: even orders are expected, those with another modulus are found
def _cells(spark, d, key_mod: str) -> DataFrame:
    o = table(spark, d, "orders").where(key_mod).select(
        (F.col("o_custkey") % 7).cast("int").alias("pair"), F.col("o_orderkey").alias("row_id"), F.lit("status").alias("col"),
        F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("value")
    )
    return o


@register("""WITH a AS (SELECT (o_custkey % 7)::INT AS pair, o_orderstatus || '|' || o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL), e AS (SELECT (o_custkey % 7)::INT AS pair, o_orderstatus || '|' || o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
 t AS (SELECT pair, sum(least(coalesce(a.n, 0), coalesce(e.n, 0)))::DOUBLE AS tp, sum(coalesce(a.n, 0))::DOUBLE AS na, sum(coalesce(e.n, 0))::DOUBLE AS ne FROM a FULL JOIN e USING (pair, v) GROUP BY pair) SELECT pair, tp / na AS precision, tp / ne AS recall, (tp = na AND tp = ne) AS exact FROM t""")
def e1_value_multiset(spark, d):
    a, e = _cells(spark, d, "o_orderkey % 3 > 0"), _cells(spark, d, "o_orderkey % 2 = 0")
    return scoring.score_values(a, e, e).select("pair", "precision", "recall", "exact")


@register("""WITH g AS (SELECT DISTINCT (o_custkey % 7)::INT AS pair, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT DISTINCT (o_custkey % 7)::INT AS pair, o_orderkey AS k FROM orders WHERE o_orderkey % 3 > 0)
 SELECT pair, count(*) FILTER (g.k IS NOT NULL AND s.k IS NOT NULL) AS tp, count(*) FILTER (g.k IS NULL) AS fp, count(*) FILTER (s.k IS NULL) AS fn FROM g FULL JOIN s USING (pair, k) GROUP BY pair""")
def e4_tuples(spark, d):
    rows = lambda c: table(spark, d, "orders").where(c).select(
        (F.col("o_custkey") % 7).cast("int").alias("pair"), F.array(F.col("o_orderkey").cast("string")).alias("row")
    )
    return scoring.score_tuples(rows("o_orderkey % 2 = 0"), rows("o_orderkey % 3 > 0")).select("pair", "tp", "fp", "fn")


@register(
    "SELECT p AS pair, least(count(*), 5)::BIGINT AS tp FROM (SELECT 1 AS p FROM part WHERE p_size = 50) GROUP BY p HAVING count(*) >= 5"
)
def e5_tied_topn(spark, d):
    part = table(spark, d, "part").where("p_size = 50").select(
        F.lit(1).alias("pair"), F.array(F.col("p_partkey").cast("string")).alias("row"), F.col("p_size").cast("double").alias("score"),
        "p_partkey"
    )
    gt, sys = part.orderBy("p_partkey").limit(5), part.orderBy(F.desc("p_partkey")).limit(5)
    return scoring.score_topn(gt.drop("p_partkey"), sys.drop("p_partkey")).select("pair", "tp")


@register("""WITH g AS (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 10),
 s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS r FROM part WHERE p_partkey % 3 > 0),
 e AS (SELECT p_brand, min(edge) AS edge, count(*) AS n, count(*) FILTER (p_size = edge) AS slots FROM g GROUP BY 1)
 SELECT e.p_brand AS pair, count(*) FILTER (s.p_size > e.edge) + least(count(*) FILTER (s.p_size = e.edge), any_value(slots)) AS tp, any_value(n) AS gt FROM e LEFT JOIN s ON s.p_brand = e.p_brand AND s.r <= 10 GROUP BY 1""")
def e5_tied_topn_brands(spark, d):
    """The ten largest parts of each brand, against those found without every third part and with ties in the other order."""
    part = table(spark, d, "part").select(
        F.col("p_brand").alias("pair"), F.array(F.col("p_partkey").cast("string")).alias("row"),
        F.col("p_size").cast("double").alias("score"), "p_partkey"
    )
    top = lambda df, tie: df.withColumn(
        "r", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("score"), tie))
    ).where("r <= 10").drop("r", "p_partkey")
    gt, sys = top(part, F.asc("p_partkey")), top(part.where("p_partkey % 3 > 0"), F.desc("p_partkey"))
    return scoring.score_topn(gt, sys).join(gt.groupBy("pair").agg(F.count(F.lit(1)).alias("gt")), "pair").select("pair", "tp", "gt")


@register(
    "SELECT o_orderpriority AS question_id, o_orderstatus AS fingerprint, n AS votes FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, min(length(o_orderkey::VARCHAR)), min(o_orderkey::VARCHAR)) AS r FROM orders GROUP BY 1, 2) WHERE r = 1"
)
def e31_vote(spark, d):
    r = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("question_id"), F.col("o_orderkey").alias("candidate"),
        F.col("o_orderkey").cast("string").alias("text"), F.col("o_orderstatus").alias("fingerprint")
    )
    return scoring.vote(r).select("question_id", "fingerprint", "votes")


# analytics: orders as runs
def _runs(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("condition"),
        F.col("o_orderstatus").alias("approach"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("score")
    )


@register(
    "SELECT o_custkey AS question_id, o_orderstatus AS approach, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1, 2"
)
def a1_latest_runs(spark, d):
    return analytics.latest_runs(_runs(spark, d), ["question_id", "approach"]).select("question_id", "approach", "run_id")


@register(
    "SELECT o_orderpriority AS condition, o_orderstatus AS approach, count(*) AS n, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority, o_orderstatus))"
)
def a9_runtime_stats(spark, d):
    t = analytics.runtime_stats(_runs(spark, d), ["score"], [[], ["approach"], ["condition", "approach"]])
    return t.select("condition", "approach", "n", F.round("p95", 4).alias("p95"), F.round("median", 4).alias("median"), "low", "high")


@register(
    "SELECT c AS condition, round(avg(m), 4) AS mean, round(coalesce(stddev_samp(m) / sqrt(count(m)), 0), 4) AS se, count(m) AS n FROM (SELECT o_orderpriority AS c, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1"
)
def a12_cell_stats(spark, d):
    return analytics.cell_stats(_runs(spark, d), ["condition"], "score").select(
        "condition", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"), "n"
    )


@register(
    "SELECT o_orderstatus AS approach, count(*) AS n, round(avg(o_totalprice), 4) AS mean_score, round(stddev_pop(o_totalprice), 4) AS std_score FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus))"
)
def a18_summary(spark, d):
    return analytics.summary(_runs(spark, d), ["score"], [[], ["approach"]], "pop").select(
        "approach", "n", F.round("mean_score", 4).alias("mean_score"), F.round("std_score", 4).alias("std_score")
    )


@register(
    "SELECT o_orderstatus AS approach, count(*) FILTER (x >= .8) AS success, count(*) FILTER (x > 0 AND x < .8) AS partial, count(*) FILTER (x = 0) AS failure FROM (SELECT o_orderstatus, (o_orderkey % 11) / 10.0::DOUBLE AS x FROM orders) GROUP BY 1"
)
def a25_categories(spark, d):
    r = _runs(spark, d).withColumn("f1", (F.col("run_id") % 11) / 10.0)
    return analytics.category_stats(r, ["approach"]).select("approach", "success", "partial", "failure")


@register(
    "SELECT question_id, prediction FROM (SELECT coalesce(b.k, a.k) AS question_id, coalesce(b.p, a.p) AS prediction FROM (SELECT o_orderkey AS k, o_orderstatus AS p FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 = 0) b ON a.k = b.k)"
)
def a29_merged_runs(spark, d):
    o = table(spark, d, "orders")
    return analytics.merge_runs(
        o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("prediction")),
        o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("prediction"))
    )


# trace events
def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("run_id", F.col("user_id"))


@register("SELECT user_id AS run_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM events GROUP BY 1")
def t8_run_summary(spark, d):
    e = _events(spark, d).withColumn("agent", F.col("event_type"))
    return traces.run_summary(e).select("run_id", "start_ts", "end_ts", "n_events")


@register(
    "SELECT run_id, ts, from_agent, to_agent FROM (SELECT user_id AS run_id, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_agent, event_type AS to_agent FROM events) WHERE from_agent IS NULL OR from_agent <> to_agent"
)
def t9_timeline(spark, d):
    return traces.timeline(_events(spark, d).withColumn("agent", F.col("event_type")))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def t10_pending(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return traces.pending(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@register("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t12_event_rates(spark, d):
    return traces.event_rates(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"
    )


@register("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts < p + INTERVAL 30 minutes THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id AS run_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, s""")
def t12_event_sessions(spark, d):
    return traces.session_rates(_events(spark, d)).select(
        "run_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n"
    )


# reshaping
FKS = [
    reshape.ForeignKey("orders", "customer", "o_custkey", "c_custkey"), reshape.ForeignKey("lineitem", "orders", "l_orderkey", "o_orderkey")
]


def _halves(spark, d) -> dict:
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    t["lineitem"] = t["lineitem"].withColumn("line_id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    one, two = reshape.split_by_keys(t, FKS, {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line_id"})
    return {"first": one, "second": two}


@register("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) <= (SELECT greatest(1, count(*) // 2) FROM customer) AS f FROM customer), o AS (SELECT o_orderkey, coalesce(f, false) AS f FROM orders LEFT JOIN c ON o_custkey = c_custkey)
 SELECT CASE WHEN f THEN 'first' ELSE 'second' END AS half, count(*) AS n_orders FROM o GROUP BY 1""")
def h1_split(spark, d):
    h = _halves(spark, d)
    parts = [t["orders"].agg(F.count(F.lit(1)).alias("n_orders")).select(F.lit(k).alias("half"), "n_orders") for k, t in h.items()]
    return parts[0].unionByName(parts[1])


@register("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) <= (SELECT greatest(1, count(*) // 2) FROM customer) AS f FROM customer), o AS (SELECT o_orderkey, o_custkey, coalesce(f, false) AS f FROM orders LEFT JOIN c ON o_custkey = c_custkey)
 SELECT CASE WHEN o.f THEN 'first' ELSE 'second' END AS half, 'orders->customer' AS fk, count(*) AS n_joined FROM o JOIN c ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT CASE WHEN f THEN 'first' ELSE 'second' END, 'lineitem->orders', count(*) FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1""")
def h5_join_integrity(spark, d):
    return reshape.check_joins(_halves(spark, d), FKS)


@register(
    "SELECT 'p_brand' AS col, count(DISTINCT p_brand) AS n_distinct, 'p brand' AS readable FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size), 'p size' FROM part"
)
def h6_profile(spark, d):
    return reshape.profile_columns("part", table(spark, d, "part").select("p_brand", "p_size")).select("col", "n_distinct", "readable")


@register("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def h7_entities(spark, d):
    return reshape.entities(graph(spark, d, [NATION]), NS + "Nation", {NS + "name": "name"}).select(key("s").alias("k"), "name")


@register(
    "SELECT o_custkey AS key, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1"
)
def h8_updates(spark, d):
    o = table(spark, d, "orders")
    log = o.select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit("status").alias("col"),
        F.col("o_orderstatus").alias("value")
    ).union(o.select("o_custkey", "o_orderkey", F.lit("priority"), "o_orderpriority"))
    return reshape.coalesce_updates(log, ["status", "priority"])


# functions
@register("SELECT doc_id, lower(trim(source)) AS v FROM documents")
def n1_norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.norm_text(F.col("source"), nfc=True).alias("v"))


# more analytics: lines are the calls of their order's run

def _run_calls(spark, d) -> DataFrame:
    """Runs with an array of calls; runs without calls are left out."""
    call = F.struct(
        F.when(F.col("l_returnflag") == "A", "search_a").otherwise("other").alias("tool_name"),
        (F.col("l_quantity") * 10).alias("output_size"), F.col("l_quantity").alias("duration_ms"),
        F.col("l_quantity").cast("int").alias("k"), F.col("l_returnflag").alias("flag")
    )
    calls = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_list(call).alias("calls"))
    return _runs(spark, d).join(calls, "run_id")


@register("""WITH r AS (SELECT o_orderkey, o_orderpriority AS condition, o_totalprice AS x, count(*) FILTER (l_returnflag = 'A') AS n, count(*) FILTER (l_returnflag = 'A' AND l_quantity * 10 <= 150) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
 SELECT condition, round(avg(x), 4) AS mean_score, round(avg(n), 4) AS searches, round(100 * sum(f) / sum(n), 4) AS failed_percent FROM r GROUP BY 1""")
def a2_condition_table(spark, d):
    t = analytics.condition_table(_run_calls(spark, d), ["score"], ["condition"])
    return t.select("condition", *(F.round(c, 4).alias(c) for c in ("mean_score", "searches", "failed_percent")))


@register(
    "SELECT o_orderpriority AS condition, round(avg((n > 3)::INT), 6) AS retry_rate FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"
)
def a3_retry_rate(spark, d):
    r = _run_calls(spark, d).withColumn("retrieval_iterations", F.size("calls") - 2)
    return analytics.retry_rate(r, ["condition"]).select("condition", F.round("retry_rate", 6).alias("retry_rate"))


@register("""SELECT instructed, coalesce(question_id, -1) AS question_id, count(*) AS n, count(*) FILTER (u AND r) AS recognised, count(*) FILTER (NOT u AND r) AS false_alarms FROM (SELECT o_orderkey % 2 = 0 AS instructed, o_custkey AS question_id, o_orderkey % 3 = 0 AS u, o_orderkey % 5 < 2 AS r FROM orders)
 GROUP BY GROUPING SETS ((instructed, question_id), (instructed))""")
def a4_recognition(spark, d):
    k = F.col("run_id")
    return analytics.recognition(
        _runs(spark, d).select(
            "question_id", (k % 2 == 0).alias("instructed"), (k % 3 == 0).alias("underspecified"), (k % 5 < 2).alias("recognised")
        )
    ).withColumn("question_id", F.coalesce("question_id", F.lit(-1)))


@register(
    "SELECT condition, round(avg(t), 4) AS tool_ms, round(avg(x), 4) AS run_ms FROM (SELECT o_orderkey, o_orderpriority AS condition, o_totalprice AS x, sum(l_quantity) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1"
)
def a5_tool_time(spark, d):
    t = analytics.tool_time(_run_calls(spark, d).withColumnRenamed("score", "total_time_ms"), ["condition"])
    return t.select("condition", F.round("tool_ms", 4).alias("tool_ms"), F.round("run_ms", 4).alias("run_ms"))


@register(
    "SELECT approach, handed_back, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg((f1 >= 0.9)::INT), 6) AS high_share FROM (SELECT o_orderstatus AS approach, o_orderkey % 2 = 0 AS handed_back, (o_orderkey % 11) / 10.0::DOUBLE AS f1 FROM orders) GROUP BY 1, 2"
)
def a6_handback(spark, d):
    r = _runs(spark, d).withColumn("handed_back", F.col("run_id") % 2 == 0).withColumn("f1", (F.col("run_id") % 11) / 10.0)
    return analytics.handback(r, ["approach"]).select(
        "approach", "handed_back", "n", F.round("mean_f1", 6).alias("mean_f1"), F.round("high_share", 6).alias("high_share")
    )


@register(
    """SELECT condition, round(sum(over) / sum(n), 6) AS over_share, max(most)::INT AS max_k, median(most)::DOUBLE AS median_max_k FROM (SELECT o_orderkey, o_orderpriority AS condition, max(l_quantity::INT) AS most, count(*) AS n, count(*) FILTER (l_quantity > 20) AS over FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1"""
)
def a7_search_size(spark, d):
    t = analytics.search_size(_run_calls(spark, d), 20, ["condition"])
    return t.select("condition", F.round("over_share", 6).alias("over_share"), "max_k", "median_max_k")


@register(
    "SELECT o_orderstatus AS approach, round(sum(o_orderkey % 3) / sum(o_orderkey % 7), 6) AS syntax_error_rate, round(sum(o_orderkey % 5) / sum(o_orderkey % 5 + o_orderkey % 2), 6) AS tool_success_rate FROM orders GROUP BY 1"
)
def a10_error_rates(spark, d):
    k = F.col("run_id")
    r = _runs(spark, d).select(
        "approach", (k % 3).alias("syntax_errors"), (k % 7).alias("queries"), (k % 5).alias("tool_ok"), (k % 5 + k % 2).alias("tool_calls")
    )
    return analytics.error_rates(r, ["approach"]).select(
        "approach", F.round("syntax_error_rate", 6).alias("syntax_error_rate"), F.round("tool_success_rate", 6).alias("tool_success_rate")
    )


@register(
    "SELECT l_returnflag || l_linestatus AS tool_name, count(*) AS calls, round(avg(l_quantity), 4) AS mean_ms FROM lineitem GROUP BY 1 ORDER BY calls DESC, tool_name LIMIT 4"
)
def a11_tool_usage(spark, d):
    calls = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("tool_name"), F.col("l_quantity").alias("duration_ms")
    )
    return analytics.tool_usage(calls, 4).select("tool_name", "calls", F.round("mean_ms", 4).alias("mean_ms"))


@register("""WITH b AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'), q AS (SELECT o_orderpriority AS c, o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (FROM b) GROUP BY 1, 2)
 SELECT c AS condition, round(avg(m), 4) AS mean, round(coalesce(stddev_samp(m) / sqrt(count(m)), 0), 4) AS se, count(m) AS n FROM q GROUP BY 1""")
def a13_paired_cells(spark, d):
    t = analytics.paired_cells(_runs(spark, d), "condition", "1-URGENT", "5-LOW", "score")
    return t.select("condition", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"), "n")


@register(
    "SELECT question_id, round(avg(m) FILTER (cell = 'F'), 4) AS f_mean, round(avg(m) FILTER (cell = 'O'), 4) AS o_mean FROM (SELECT o_custkey AS question_id, o_orderstatus AS cell, o_orderpriority AS model, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY 1"
)
def a14_group_scores(spark, d):
    r = _runs(spark, d).withColumnsRenamed({"approach": "cell", "condition": "model"})
    return analytics.group_scores(r, "score", ["F", "O"]).select(
        "question_id", F.round("F", 4).alias("f_mean"), F.round("O", 4).alias("o_mean")
    )


@register(
    "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'entity' WHEN p_size * 2 > 50 THEN 'displaced' ELSE 'bridged' END AS subtype, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1"
)
def a15_subtypes(spark, d):
    q = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 3 == 0, "instance").otherwise("class").alias("target_kind"), (F.col("p_size") * 2).alias("worst_rank"),
        F.col("p_retailprice").alias("score")
    )
    return analytics.subtypes(q).select("subtype", "n", F.round("mean", 4).alias("mean"))


@register(
    "SELECT o_orderpriority AS template, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 2) AS variance, count(*) FILTER (o_orderkey % 4 = 0) AS failures FROM orders GROUP BY 1"
)
def a23_template_summary(spark, d):
    r = _runs(spark, d).withColumn("success", F.col("run_id") % 4 > 0).withColumnRenamed("condition", "template")
    return analytics.template_summary(r, "score").select(
        "template", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), "failures"
    )


@register(
    "SELECT CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) THEN 'no_reading' WHEN o_orderkey % 4 = 0 THEN 'failed_run' WHEN o_orderstatus = 'P' THEN 'no_prediction' ELSE 'evaluated' END AS reason, count(*) AS n FROM orders GROUP BY 1"
)
def a30_skips(spark, d):
    readings = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("question_id"))
    r = _runs(spark, d).withColumn("success", F.col("run_id") % 4 > 0).withColumn("prediction", F.nullif(F.col("approach"), F.lit("P")))
    return analytics.skip_report(r, readings)


# more trace events: kinds by the parity of the event's number
@register(
    """SELECT run_id, phase, start_ts, end_ts FROM (SELECT user_id AS run_id, event_type AS phase, ts AS start_ts, event_id % 3 AS k, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM events) WHERE k = 0"""
)
def t1_phases(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "phase_start").when(F.col("event_id") % 3 == 1, "phase_end").otherwise("run_end")
    e = _events(spark, d).withColumn("phase", F.col("event_type")).withColumn("event_type", kind).withColumn("duration_ms", F.col("value"))
    return traces.phase_intervals(e).select("run_id", "phase", "start_ts", "end_ts")


@register(
    "SELECT a.event_id // 2 AS call_id, a.ts AS call_ts, b.ts AS result_ts, b.value AS duration_ms FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_id % 2 = 0 WHERE b.ts >= a.ts"
)
def t2_call_pairs(spark, d):
    call = F.floor(F.col("event_id") / 2)
    e = table(spark, d, "events").select(
        (call % 50).alias("run_id"), call.alias("call_id"), F.col("event_type").alias("agent"), "ts", F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 2 == 0, "tool_call").otherwise("tool_result").alias("event_type")
    )
    return traces.pair_calls(e).select("call_id", "call_ts", "result_ts", "duration_ms")


@register(
    "SELECT event_id, CASE WHEN k = 1 THEN n END AS tokens FROM (SELECT event_id, lead(value) OVER w AS n, lead(event_id % 2) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_id % 2 = 0"
)
def t3_llm_calls(spark, d):
    e = _events(spark, d).withColumn(
        "event_type", F.when(F.col("event_id") % 2 == 0, "llm_call").otherwise("llm_result")
    ).withColumn("tokens", F.col("value"))
    return traces.llm_calls(e).select("event_id", "tokens")


@register(
    "SELECT event_type AS agent, count(*) AS n, round(sum(value - 50), 4) AS total, round(min(value - 50), 4) AS low, round(max(value - 50), 4) AS high FROM events WHERE value > 50 GROUP BY 1"
)
def t4_agent_times(spark, d):
    t = traces.agent_times(
        _events(spark, d).select("run_id", F.col("event_type").alias("agent"), (F.col("value") - 50).alias("duration_ms"))
    )
    return t.select("agent", "n", *(F.round(c, 4).alias(c) for c in ("total", "low", "high")))


@register(
    "SELECT run_id, total, a AS A, r AS R, greatest(0, total - a - r)::BIGINT AS orchestrator FROM (SELECT l_orderkey AS run_id, 120::BIGINT AS total, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'A'), 0)::BIGINT AS a, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R'), 0)::BIGINT AS r FROM lineitem GROUP BY 1)"
)
def t7_run_totals(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("phase"), F.col("l_quantity").cast("long").alias("tokens"),
        F.lit(120).cast("long").alias("total")
    )
    return traces.run_totals(c, ["A", "R"])


# more linking
@register("SELECT p_partkey AS k, p_name || ' ' || p_brand AS v FROM part")
def l2_camel(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.expand_camel(F.concat("p_name", "p_brand")).alias("v"))


@register("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE regexp_matches(c_mktsegment, 'build|auto', 'i')")
def l6_grep_values(spark, d):
    return linking.grep_values(graph(spark, d, [CUSTOMER], terms.RDF_TYPE, NS + "segment"), NS + "Customer", NS + "segment", "build|auto")


RANKS = "(SELECT p_brand AS phrase, p_partkey AS element, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS type_rank FROM part)"


def _ranks(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("phrase"), F.col("p_partkey").alias("element"), F.col("p_type").alias("type"),
        F.col("p_size").alias("domain"), F.col("p_retailprice").alias("score")
    )
    return linking.target_rank(p, p.where("element % 10 = 0").select("phrase", "element", "domain"))


@register(f"SELECT phrase, element, rank::INT AS rank, type_rank::INT AS type_rank FROM {RANKS} WHERE element % 10 = 0")
def l12_target_rank(spark, d):
    return _ranks(spark, d)


@register(
    f"SELECT phrase, bool_and(type_rank <= 5 AND rank <= 15) AS reachable, max(rank)::INT AS worst_rank FROM {RANKS} WHERE element % 10 = 0 GROUP BY 1"
)
def l13_reachability(spark, d):
    return linking.reachability(_ranks(spark, d), 5)


@register(
    """SELECT DISTINCT p_partkey AS id, unnest([p_name] || list_transform(range(1, len(w)), lambda i: array_to_string(w[1:i], ' ')) || list_transform(range(1, len(w)), lambda i: array_to_string(w[i + 1:], ' '))) AS part FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)"""
)
def l18_keyword_parts(spark, d):
    return linking.keyword_parts(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("keyword")))


@register("SELECT p_size AS query_id, p_brand AS tbl, p_type AS col, min(p_partkey) AS rank FROM part GROUP BY 1, 2, 3")
def l21_describe(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_size").alias("query_id"), F.col("p_brand").alias("tbl"), F.col("p_type").alias("col"), F.col("p_name").alias("text"),
        F.col("p_partkey").alias("rank")
    )
    return linking.describe(p).select("query_id", "tbl", "col", "rank")


@register(
    "SELECT 'shop' AS dataset, term, count(*) AS n, min('http://example.org/customer/' || c_custkey) AS example FROM (SELECT c_custkey, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, c_name FROM customer) JOIN (VALUES ('build'), ('customer#')) t(term) ON contains(lower(v), term) GROUP BY 2"
)
def l22_search_instances(spark, d):
    g = graph(spark, d, [CUSTOMER], NS + "segment", NS + "name").withColumn("dataset", F.lit("shop"))
    return linking.search_instances(
        g, spark.createDataFrame([("build",), ("Customer#",), ("ab",)], "term string").withColumn("term", F.lower("term"))
    )


# more scoring
@register(
    "SELECT run_id, reading_id FROM (SELECT o_custkey AS run_id, o_orderkey AS reading_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC, o_orderkey % 5 DESC, o_orderkey % 7 DESC, o_orderkey) AS r FROM orders) WHERE r = 1"
)
def e17_best_reading(spark, d):
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), k.alias("reading_id"), (k % 3).alias("schema_recall"), (k % 5).alias("data_f1"),
        (k % 7).alias("schema_precision")
    )
    return scoring.best_reading(s).select("run_id", "reading_id")


@register(
    "SELECT o_custkey AS question_id, o_orderstatus AS term, 'property' AS kind, CASE WHEN bool_or(o_orderkey % 4 = 0) THEN 'required' ELSE 'acceptable' END AS necessity FROM orders GROUP BY 1, 2"
)
def e23_retrieval_truth(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("p"), F.col("o_orderpriority").alias("o"),
        F.when(F.col("o_orderkey") % 4 == 0, "required").otherwise("acceptable").alias("necessity")
    )
    return scoring.retrieval_truth(o)


@register(
    "SELECT DISTINCT q, kind, term FROM (SELECT o_custkey AS q, 'class' AS kind, o_orderstatus AS term FROM orders UNION ALL SELECT o_custkey, 'property', o_orderpriority FROM orders UNION ALL SELECT o_custkey, 'class', 'Day' || (o_orderkey % 3) FROM orders)"
)
def e29_triple_terms(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("q"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"),
        F.concat(F.lit("Day"), (F.col("o_orderkey") % 3).cast("string")).alias("o")
    )
    return scoring.triple_terms(o)


@register("SELECT o_custkey AS pair, (bool_and(o_orderkey % 5 > 0))::INT AS correct FROM orders GROUP BY 1")
def e30_same_result(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("k"), F.array(F.col("o_orderkey").cast("string")).alias("row")
    )
    return scoring.same_result(o.select("pair", "row"), o.where("k % 5 > 0").select("pair", "row"), o)


CANDS = "(SELECT o_custkey AS question_id, o_orderkey AS candidate, o_orderstatus AS fingerprint, o_orderkey % 3 AS score, o_orderkey % 4 > 0 AS ok, o_orderkey % 6 AS n_rows FROM orders)"


def _cands(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), k.alias("candidate"), F.col("o_orderstatus").alias("fingerprint"), (k % 3).alias("score"),
        (k % 4 > 0).alias("ok"), (k % 6).alias("n_rows")
    )


@register(
    f"SELECT question_id, candidate FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, votes DESC, candidate) AS r FROM (SELECT *, count(*) OVER (PARTITION BY question_id, fingerprint) AS votes FROM {CANDS})) WHERE r = 1"
)
def e32_pick_best(spark, d):
    return scoring.pick_best(_cands(spark, d)).select("question_id", "candidate")


@register(f"""WITH s AS (SELECT question_id, fingerprint, count(*) AS k, count(*) FILTER (ok) AS o, count(*) FILTER (n_rows > 0) AS f FROM {CANDS} GROUP BY 1, 2)
 SELECT question_id, round(max(k) / sum(k), 6) AS agreement, count(*) AS n_groups, round(0.3 * sum(o) / sum(k) + 0.5 * max(k) / sum(k) + CASE WHEN sum(f) > 0 THEN 0.2 ELSE 0.1 END, 6) AS confidence FROM s GROUP BY 1""")
def e33_agreement(spark, d):
    return scoring.agreement(_cands(spark, d)).select(
        "question_id", F.round("agreement", 6).alias("agreement"), "n_groups", F.round("confidence", 6).alias("confidence")
    )




def queries() -> dict[str, Query]:
    from graphloom import catalog_joins, catalog_more, catalog_partial, catalog_rules, catalog_traces  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from graphloom import catalog_joins, catalog_more, catalog_partial, catalog_rules, catalog_traces  # noqa: F401

    return dict(SQL)

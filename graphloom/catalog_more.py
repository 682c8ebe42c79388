"""Queries of the operators that have none elsewhere: sources, mapping, patterns, schema, linking, scoring, reshaping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import CUSTOMER, NS, ORDER, REGION, SHOP, SUPPLIER, I, _events, _runs, _Tables, graph, iri, key, mapped
from graphloom.catalog_rules import pick, pick_sql
from graphloom.functions import terms
from graphloom.operators import analytics, linking, patterns, reshape, schema, scoring
from graphloom.operators.patterns import scan
from graphloom.plans import mapping as m
from graphloom.registry import register, table
from graphloom.sizes import shared_folder
from graphloom.sources import files
from graphloom.streaming import traces


def scratch(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


# sources and sinks
@register(
    "SELECT c_custkey::VARCHAR AS key, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer"
)
def s1_read_csv(spark, d):
    path = scratch(spark)
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("the key"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise(F.lit("  ")).alias("seg-ment")
    )
    c.write.option("sep", ";").option("header", True).option(
        "ignoreTrailingWhiteSpace", False
    ).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.read_csv_loose(spark, path).select(F.col("the_key").alias("key"), "name", F.col("seg_ment").alias("segment"))


@register(
    "SELECT 'nation' AS tbl, 25::BIGINT AS n, count(*) FILTER (n_nationkey::VARCHAR = n_nationkey::VARCHAR) AS texts FROM nation UNION ALL SELECT 'customer', least(40, count(*)), least(40, count(*)) FROM customer"
)
def s3_sample_tables(spark, d):
    few = files.sample_tables({n: table(spark, d, n) for n in ("nation", "customer")}, 40)
    counts = [
        df.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.typeof(F.col(df.columns[0])) == "string").alias("texts")
        ).select(F.lit(n).alias("tbl"), "n", "texts") for n,
        df in few.items()
    ]
    return counts[0].unionByName(counts[1])


@register(
    "SELECT kind, n FROM (SELECT 'runs' AS kind, count(*) FILTER (o_custkey % 4 < 2) AS n FROM orders UNION ALL SELECT 'incomplete', count(*) FILTER (o_custkey % 4 = 2) FROM orders UNION ALL SELECT 'unreadable', count(*) FILTER (o_custkey % 4 = 3) FROM orders) WHERE n > 0"
)
def s4_read_runs(spark, d):
    """Each order as a JSON document of its own line, some broken or without a question."""
    path = scratch(spark)
    k = F.col("o_custkey") % 4
    doc = F.to_json(
        F.struct(F.col("o_orderkey").cast("string").alias("run_id"), F.when(k < 2, F.col("o_custkey").cast("string")).alias("question_id"))
    )
    table(spark, d, "orders").select(
        F.when(k == 3, F.concat(F.lit("{broken "), F.col("o_orderkey").cast("string"))).otherwise(doc).alias("value")
    ).write.text(path)
    runs, rejects = files.read_runs(spark, path, "run_id string, question_id string", multi_line=False)
    return runs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("runs").alias("kind"), "n").unionByName(
        rejects.withColumnRenamed("reason", "kind")
    )


@register("SELECT least(500, count(*)) AS n, 0::BIGINT AS strange FROM lineitem")
def s5_shrink(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    few = files.shrink(lines, 500)
    known = lines.distinct().withColumn("known", F.lit(1))
    return few.join(known, ["l_orderkey", "l_linenumber"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("strange")
    )


@register(
    f"SELECT '{NS}name' AS p, count(*) AS n, count(DISTINCT c_name) AS values FROM customer UNION ALL SELECT '{NS}segment', count(*), count(DISTINCT c_mktsegment) FROM customer"
)
def s7_triples_on_disk(spark, d):
    path = scratch(spark)
    files.write_triples(graph(spark, d, [CUSTOMER], NS + "name", NS + "segment"), path)
    return files.read_triples(spark, path).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o").alias("values"))


@register("SELECT o_orderpriority AS condition, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def s8_write_eval(spark, d):
    path = scratch(spark)
    files.write_eval(_runs(spark, d).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean")), path)
    return spark.read.json(path).select("condition", "n", "mean")


# mapping: one map with each kind of object
KINDS = m.TriplesMap(
    lambda t: t["customer"].select(
        "c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("seg")
    ),
    iri("customer", "c_custkey"), (NS + "Customer", NS + "Agent"),
    (m.obj_col(NS + "name", "c_name", lang="en"), m.obj_col(NS + "segment", "seg", "token"), m.obj_tpl(NS + "inNation", iri("nation", "c_nationkey")), m.const(NS + "status", "active", literal=True), m.const(NS + "source", "http://example.org/shop"), m.obj_tpl(NS + "label", "{c_name}/{seg}", literal=True)),
)


@register(f"""SELECT p, o_kind, o_datatype, o_lang, count(*) AS n, count(DISTINCT o) AS objects FROM (SELECT '{terms.RDF_TYPE}' AS p, unnest(['{NS}Customer', '{NS}Agent']) AS o, 'iri' AS o_kind, NULL AS o_datatype, NULL AS o_lang FROM customer
 UNION ALL SELECT '{NS}name', c_name, 'literal', NULL, 'en' FROM customer UNION ALL SELECT '{NS}segment', c_mktsegment, 'literal', '{terms.XSD}token', NULL FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT '{NS}inNation', {I}nation/' || c_nationkey, 'iri', NULL, NULL FROM customer
 UNION ALL SELECT '{NS}status', 'active', 'literal', NULL, NULL FROM customer UNION ALL SELECT '{NS}source', 'http://example.org/shop', 'iri', NULL, NULL FROM customer UNION ALL SELECT '{NS}label', c_name || '/' || c_mktsegment, 'literal', NULL, NULL FROM customer WHERE c_custkey % 5 > 0) GROUP BY ALL""")
def m1_object_kinds(spark, d):
    """A view, several classes, columns with datatype and language, templates, constants; null cells give no triple."""
    g = m.triples([KINDS], _Tables(spark, d))
    return g.groupBy("p", "o_kind", "o_datatype", "o_lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o").alias("objects"))


@register(
    "SELECT c_custkey AS k, 'http://example.org/' || replace(replace(c_mktsegment || ' & ' || c_custkey, ' ', '%20'), '&', '%26') AS iri, c_mktsegment || ' & ' || c_custkey AS plain FROM customer"
)
def m6_templates(spark, d):
    """M6, M9: percent-encoded in IRIs, plain in texts."""
    c = table(spark, d, "customer").withColumn("v", F.concat("c_mktsegment", F.lit(" & "), F.col("c_custkey").cast("string")))
    return c.select(
        F.col("c_custkey").alias("k"), terms.from_template("http://example.org/{v}").alias("iri"),
        terms.from_template("{v}", encode=False).alias("plain")
    )


@register(f"SELECT '{NS}Nation' AS cls, count(*) AS n FROM nation UNION ALL SELECT '{NS}Region', count(*) FROM region")
def m17_by_class(spark, d):
    t = _Tables(spark, d)
    parts = [
        m.triples(SHOP, t, cls=c).agg(
            F.count(F.lit(1)).alias("n")
        ).select(F.lit(c).alias("cls"), "n") for c in (NS + "Nation", NS + "Region")
    ]
    return parts[0].unionByName(parts[1])


@register("SELECT 'http://example.org/part/{p_partkey}: p_colour' AS problem, count(*) AS n_rows FROM part")
def m19_mapping_problems(spark, d):
    wrong = m.TriplesMap("part", iri("part", "p_partkey"), (), (m.obj_col(NS + "colour", "p_colour"), m.obj_col(NS + "size", "p_size")))
    found = spark.createDataFrame([(x,) for x in m.check_mapping([wrong, REGION], _Tables(spark, d))], "problem string")
    return found.join(F.broadcast(table(spark, d, "part").agg(F.count(F.lit(1)).alias("n_rows"))))


@register(f"SELECT count(*) AS n, 'Customer' AS name, '{NS}' AS namespace FROM customer")
def m23_local_names(spark, d):
    g = graph(spark, d, [CUSTOMER], terms.RDF_TYPE)
    return g.groupBy(
        terms.local_name(F.col("o")).alias("name"), terms.namespace(F.col("o")).alias("namespace")
    ).agg(F.count(F.lit(1)).alias("n"))


# patterns
@register("SELECT a.n_nationkey::BIGINT AS k, a.n_name AS name FROM nation a WHERE a.n_regionkey = a.n_nationkey")
def p1_repeated_variable(spark, d):
    """Nations whose region has their own number: one variable in two places, and a constant predicate."""
    same = m.TriplesMap(
        "nation", iri("place", "n_nationkey"), (), (m.obj_tpl(NS + "in", iri("place", "n_regionkey")), m.obj_col(NS + "name", "n_name"))
    )
    g = m.triples([same], _Tables(spark, d))
    found = patterns.natural(scan(g, "?x", NS + "in", "?x"), scan(g, "?x", NS + "name", "?name"))
    return found.select(key("x").alias("k"), "name")


@register("SELECT s_suppkey::BIGINT AS k FROM supplier")
def p3_typed(spark, d):
    return patterns.typed(graph(spark, d, [SUPPLIER, CUSTOMER], terms.RDF_TYPE), "?s", NS + "Supplier").select(key("s").alias("k"))


@register("""WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS c FROM orders), r AS (SELECT c_custkey AS c, c_mktsegment AS v FROM customer WHERE c_nationkey = 7)
 SELECT n.k, coalesce(n.c, r.c) AS c, r.v FROM n LEFT JOIN r ON n.c = r.c OR n.c IS NULL""")
def p5_optional_unbound(spark, d):
    """An unbound variable fits any value."""
    left = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("c")
    )
    right = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("v"))
    return patterns.optional(left, right, ("c",))


@register("SELECT o_orderkey::BIGINT AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def p10_in(spark, d):
    return patterns.where_in(
        mapped(spark, d, ORDER).solve([("?x", NS + "priority", "?v")]).bindings(), "v", ["1-URGENT", "3-MEDIUM"]
    ).select(key("x").alias("k"))


@register("SELECT c_custkey::BIGINT AS k FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
def p12_ucase(spark, d):
    return patterns.where_ucase(
        mapped(spark, d, CUSTOMER).solve([("?x", NS + "segment", "?v")]).bindings(), "v", "BUILDING"
    ).select(key("x").alias("k"))


@register("SELECT DISTINCT c_mktsegment AS v, 'shop' AS origin, length(c_mktsegment) AS n FROM customer")
def p14_bind_project(spark, d):
    """A constant and an expression are bound, then projected without duplicates."""
    rows = mapped(spark, d, CUSTOMER).solve([("?x", NS + "segment", "?v")]).bindings()
    bound = patterns.bind(patterns.bind(rows, "origin", "shop"), "n", F.length("v"))
    return patterns.project(bound, ["v", "origin", "n"], distinct=True)


@register(
    "SELECT p_brand AS brand, min(p_type) AS any_type, max(p_size)::DOUBLE AS largest, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1"
)
def p19_sample(spark, d):
    """P19, P22."""
    p = table(spark, d, "part")
    return patterns.group(
        p.select(F.col("p_brand").alias("brand"), "p_type", F.col("p_size").cast("string").alias("v")), ["brand"],
        any_type=patterns.sample("p_type"), largest=F.max(patterns.number("v")), sizes=F.count_distinct("v")
    )


@register(
    "SELECT c_mktsegment AS v, c_custkey::BIGINT AS k, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) AS place FROM customer QUALIFY place <= 7"
)
def p25_top(spark, d):
    """Ordered by several keys, the first seven."""
    rows = mapped(spark, d, CUSTOMER).solve([("?x", NS + "segment", "?v")]).bindings().withColumn("k", key("x"))
    best = patterns.order(patterns.top(rows, 7, F.desc("v"), "k"), F.desc("v"), "k")
    return best.select("v", "k", F.row_number().over(Window.orderBy(F.desc("v"), "k")).cast("long").alias("place"))  # seven rows


@register(
    "SELECT count(*)::BIGINT AS n, max(length(name))::INT AS longest FROM (SELECT left('http://example.org/customer/' || c_custkey, 12) AS name FROM customer LIMIT 10)"
)
def p26_preview(spark, d):
    rows = patterns.preview(mapped(spark, d, CUSTOMER).solve([("?x", NS + "segment", "?v")]).bindings(), 50, 12)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("x")).alias("longest"))


@register(
    f"SELECT 'shop' AS dataset, 3::BIGINT AS n_terms FROM customer HAVING count(*) > 0 UNION ALL SELECT 'rdf', 1 FROM customer HAVING count(*) > 0"
)
def p29_datasets(spark, d):
    used = graph(spark, d, [CUSTOMER]).where(F.col("p") != NS + "inNation").select(
        F.explode(F.array("p", F.when(F.col("p") == terms.RDF_TYPE, F.col("o")))).alias("term")
    ).where("term is not null")
    registry = spark.createDataFrame(
        [("shop", NS), ("rdf", terms.RDF_TYPE[:-4]), ("other", "http://other.org/")], "dataset string, prefix string"
    )
    return patterns.datasets_for(used, registry)


@register(
    f"SELECT p, n FROM (SELECT '{NS}name' AS p, count(*) AS n FROM customer UNION ALL SELECT '{NS}segment', count(*) FROM customer UNION ALL SELECT '{NS}inNation', count(*) FROM customer UNION ALL SELECT '{terms.RDF_TYPE}', count(*) FROM customer)"
)
def p30_predicates(spark, d):
    return patterns.predicate_counts(graph(spark, d, [CUSTOMER]))


@register(
    "SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 100"
)
def p32_steps(spark, d):
    steps = patterns.Steps().add(
        "c", table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    ).add("o", table(spark, d, "orders").select(F.col("o_custkey").alias("k")))
    steps.join("both", "c", "o", "k").apply(
        "done", lambda r: r["both"].groupBy("segment").agg(F.count(F.lit(1)).alias("n")).where("n > 100")
    )
    return steps.results["done"]


@register(
    "SELECT c_custkey::BIGINT AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
)
def p7_minus_urgent(spark, d):
    g = mapped(spark, d, CUSTOMER, ORDER)
    urgent = g.solve([("?o", NS + "by", "?c"), ("?o", NS + "priority", "1-URGENT")])
    return g.solve([("?c", terms.RDF_TYPE, NS + "Customer")]).join(urgent, "left_anti").bindings("c").select(key("c").alias("k"))


# schema: classes are part types, properties the tables' columns of parts of a type
def _part_schema(spark, d) -> DataFrame:
    """(class, property, range, is_object): parts of a type and size have a property of that size; its range is the brand."""
    p = table(spark, d, "part")
    return p.select(
        F.regexp_replace("p_type", " ", "_").alias("class"),
        F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string")).alias("property"),
        F.concat(F.lit("Brand"), (F.col("p_partkey") % 3).cast("string")).alias("range"), (F.col("p_partkey") % 3 > 0).alias("is_object")
    ).distinct()


SCHEMA = "(SELECT DISTINCT replace(p_type, ' ', '_') AS class, 'size' || (p_size % 5) AS property, 'Brand' || (p_partkey % 3) AS \"range\", p_partkey % 3 > 0 AS is_object FROM part)"
PARENTS = "(SELECT DISTINCT replace(p_type, ' ', '_') AS child, split_part(p_type, ' ', 1) || '_Part' AS parent FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) || '_Part', 'Part' FROM part)"


def _parents(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(
        F.regexp_replace("p_type", " ", "_").alias("child"),
        F.concat(F.element_at(F.split("p_type", " "), 1), F.lit("_Part")).alias("parent")
    )
    return p.union(p.select("parent", F.lit("Part"))).distinct()


def _ancestors(spark, d) -> DataFrame:
    return schema.closure(_parents(spark, d)).select("child", "ancestor")


ANCESTORS = f"(SELECT child, parent AS ancestor FROM {PARENTS} UNION SELECT a.child, b.parent FROM {PARENTS} a JOIN {PARENTS} b ON a.parent = b.child)"


@register(
    f"SELECT property, array_to_string(list_sort(list(DISTINCT class)), ',') AS domains, array_to_string(list_sort(list(DISTINCT \"range\")), ',') AS ranges, bool_or(is_object) AS is_object FROM {SCHEMA} GROUP BY 1"
)
def g4_views_of_parts(spark, d):
    return schema.schema_views(_part_schema(spark, d)).select(
        "property", F.array_join("domains", ",").alias("domains"), F.array_join("ranges", ",").alias("ranges"), "is_object"
    )


@register(f"SELECT DISTINCT ancestor AS class, property, s.\"range\", is_object FROM {SCHEMA} s JOIN {ANCESTORS} a ON a.child = s.class")
def g2_lifted(spark, d):
    """No part type is the range of a property here, so ranges stay."""
    return schema.lift_schema(_part_schema(spark, d), _parents(spark, d))


@register(
    f"WITH a AS (SELECT * FROM {SCHEMA} WHERE NOT is_object), b AS (SELECT * FROM {SCHEMA} WHERE is_object) SELECT u.*, coalesce((SELECT max(\"range\") FROM b WHERE b.property = u.property), (SELECT max(\"range\") FROM a WHERE a.property = u.property)) AS global_range FROM (SELECT * FROM a UNION SELECT * FROM b) u"
)
def g5_merged(spark, d):
    s = _part_schema(spark, d)
    return schema.merge_schemas([s.where("not is_object"), s.where("is_object")])


@register(
    f"WITH s AS {SCHEMA} SELECT class, property, \"range\" FROM s UNION SELECT a.child, s.property, s.\"range\" FROM {ANCESTORS} a JOIN (SELECT 'Part' AS class, 'name' AS property, 'text' AS \"range\" UNION ALL SELECT class, property, \"range\" FROM s) s ON s.class = a.ancestor UNION SELECT 'Part', 'name', 'text' FROM s"
)
def g6_class_properties(spark, d):
    own = _part_schema(spark, d).unionByName(
        spark.createDataFrame([("Part", "name", "text", False)], "class string, property string, range string, is_object boolean")
    )
    return schema.class_properties(own, _ancestors(spark, d))


@register(
    f"WITH s AS {SCHEMA} SELECT property AS element, 'property' AS type, count(DISTINCT class) AS n_from, count(DISTINCT \"range\") FILTER (is_object) AS n_to FROM s GROUP BY 1 UNION ALL SELECT coalesce(c.class, r.\"range\"), 'class', coalesce(p, 0), coalesce(f, 0) FROM (SELECT class, count(DISTINCT property) AS p FROM s GROUP BY 1) c FULL JOIN (SELECT \"range\", count(DISTINCT class) AS f FROM s WHERE is_object GROUP BY 1) r ON c.class = r.\"range\""
)
def g7_elements(spark, d):
    e = schema.elements(_part_schema(spark, d))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    prop = F.col("type") == "property"
    return e.select(
        "element", "type", F.when(prop, n("defined_in")).otherwise(n("properties")).alias("n_from"),
        F.when(prop, n("connects_to")).otherwise(n("connected_from")).alias("n_to")
    )


@register(
    f"WITH w AS (SELECT DISTINCT class AS a, \"range\" AS b, property AS via FROM {SCHEMA} WHERE is_object UNION SELECT child, parent, 'subClassOf' FROM {PARENTS}) SELECT a, b, via, false AS reverse FROM w UNION ALL SELECT b, a, via, true FROM w"
)
def g8_connections(spark, d):
    return schema.connection_graph(_part_schema(spark, d), _parents(spark, d))


@register(f"""WITH RECURSIVE w AS (SELECT DISTINCT class AS a, "range" AS b FROM {SCHEMA} WHERE is_object UNION SELECT child, parent FROM {PARENTS}), e AS (SELECT a, b FROM w UNION SELECT b, a FROM w),
p AS (SELECT a, b, [a, b] AS path FROM e UNION ALL SELECT p.a, e.b, list_append(p.path, e.b) FROM p JOIN e ON e.a = p.b WHERE NOT list_contains(p.path, e.b) AND len(p.path) < 4 AND p.a = 'Brand1'), q AS (SELECT * FROM p WHERE a = 'Brand1' AND b IN ('Brand2', 'Part'))
SELECT a, b, len(min_by(path, (len(path), path))) - 1 AS hops, array_to_string(min_by(path, (len(path), path)), '>') AS path FROM q GROUP BY a, b""")
def g9_paths_of_parts(spark, d):
    g = schema.connection_graph(_part_schema(spark, d), _parents(spark, d))
    found = schema.path_through(g, ["Brand2", "Brand1", "Part"])
    back = found.where("a = 'Brand2'").select("b", "a", "hops", "path")
    # both neighbours start at Brand1
    turned = schema.shortest_paths(g, spark.createDataFrame([("Brand1", "Brand2")], "a string, b string")).join(
        back.select(F.col("hops").alias("h")), F.col("hops") == F.col("h"), "left_semi"
    )
    return turned.unionByName(found.where("a = 'Brand1'")).select(
        "a", "b", F.col("hops").cast("long").alias("hops"), F.array_join("path", ">").alias("path")
    )


@register(
    f"WITH s AS {SCHEMA} SELECT DISTINCT '?x' AS variable, class, 'domain' AS reason FROM s WHERE property = 'size1' UNION SELECT '?y', \"range\", 'range' FROM s WHERE property = 'size1' AND is_object UNION SELECT '?z', 'Part', 'type' FROM s"
)
def g12_types(spark, d):
    p = spark.createDataFrame(
        [("?x", "size1", "?y"), ("?z", terms.RDF_TYPE, "Part"), ("?z", "unknown", "?w")], "s string, p string, o string"
    )
    return schema.infer_types(p, _part_schema(spark, d))


@register(f"""WITH s AS {SCHEMA}, t AS (SELECT DISTINCT class AS c FROM s), have AS (SELECT DISTINCT class, property FROM s), facts AS (SELECT c, unnest(['size0', 'size4', 'weight']) AS p FROM t)
SELECT p, issue, severity, count(*) AS n FROM (SELECT p, c, 'class property mismatch' AS issue, 'error' AS severity FROM facts WHERE (c, p) NOT IN (FROM have) UNION ALL SELECT p, c, 'domain mismatch', 'warning' FROM facts WHERE p <> 'weight' AND (c, p) NOT IN (FROM have) UNION ALL SELECT p, c, 'unknown property', 'error' FROM facts WHERE p = 'weight'
 UNION ALL SELECT p, c, 'range mismatch', 'warning' FROM facts f WHERE EXISTS (SELECT 1 FROM s WHERE s.property = f.p) AND NOT EXISTS (SELECT 1 FROM s WHERE s.property = f.p AND NOT is_object)) GROUP BY ALL""")
def g13_issues(spark, d):
    """Every part type asked for three properties with a literal object."""
    s = _part_schema(spark, d)
    t = s.select("class").distinct().withColumn("v", F.concat(F.lit("?"), "class"))
    asked = t.select(
        F.col("v").alias("s"), F.explode(F.array(*map(F.lit, ("size0", "size4", "weight")))).alias("p"), F.lit("5").alias("o")
    ).unionByName(t.select(F.col("v").alias("s"), F.lit(terms.RDF_TYPE).alias("p"), F.col("class").alias("o")))
    return schema.validate(asked, s, _ancestors(spark, d)).groupBy("p", "issue", "severity").agg(F.count(F.lit(1)).alias("n"))


@register(
    "SELECT o_custkey AS query_id, count(*) AS n_patterns, count(*) FILTER (o_orderkey % 3 = 0) AS n_types, (count(DISTINCT o_orderstatus) + count(DISTINCT CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END))::BIGINT AS n_variables FROM orders GROUP BY 1"
)
def g16_pattern_facts(spark, d):
    o = table(spark, d, "orders")
    kind = F.col("o_orderkey") % 3 == 0
    return schema.pattern_facts(
        o.select(
            F.col("o_custkey").alias("query_id"), F.concat(F.lit("?"), "o_orderstatus").alias("s"),
            F.when(kind, terms.RDF_TYPE).otherwise("p").alias("p"),
            F.when(kind, "Class").otherwise(F.concat(F.lit("?v"), F.col("o_orderkey").cast("string"))).alias("o")
        )
    )


@register(
    f"SELECT class, count(DISTINCT property) AS n_properties, count(DISTINCT (property, \"range\")) FILTER (is_object) AS n_links FROM {SCHEMA} GROUP BY 1"
)
def g17_classes(spark, d):
    return schema.list_classes(_part_schema(spark, d))


@register(
    f"WITH c AS (SELECT min(class) AS c FROM {SCHEMA}) SELECT c AS class, (SELECT array_to_string(list_sort(list(DISTINCT property || ':' || \"range\")), ',') FROM {SCHEMA} WHERE class = c) AS properties, (SELECT array_to_string(list_sort(list(DISTINCT parent)), ',') FROM {PARENTS} WHERE child = c) AS parents FROM c"
)
def g17_class_card(spark, d):
    s = _part_schema(spark, d)
    first = s.agg(F.min("class")).first()[0]
    card = schema.class_card(s, _parents(spark, d), first)
    return card.select(
        "class", F.array_join(F.transform("properties", lambda x: F.concat_ws(":", x["property"], x["range"])), ",").alias("properties"),
        F.array_join("parents", ",").alias("parents")
    )


@register(f"""WITH v AS (SELECT DISTINCT replace(p_type, ' ', '_') AS class, 'size' || (p_size % 5) AS property, p_brand AS v FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY class, property ORDER BY v) AS r FROM v)
SELECT s.class, s.property, s."range", array_to_string(list_sort((SELECT list(v) FROM r WHERE r.r <= 3 AND r.class = s.class AND r.property = s.property)), ',') AS samples FROM {SCHEMA} s WHERE property IN ('size1', 'size2')""")
def g18_filtered(spark, d):
    s = _part_schema(spark, d)
    keep = s.where("property in ('size1', 'size2')").select("class", "property").distinct()
    values = table(spark, d, "part").select(
        F.regexp_replace("p_type", " ", "_").alias("class"),
        F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string")).alias("property"), F.col("p_brand").alias("value")
    )
    return schema.filter_schema(s, keep, values).select("class", "property", "range", F.array_join("samples", ",").alias("samples"))


@register(
    f"SELECT DISTINCT '{NS}' || replace(p_type, ' ', '_') AS class, '{NS}' || x.p AS property, '{terms.XSD}' || x.r AS \"range\", false AS is_object FROM part, (VALUES ('size', 'integer'), ('brand', 'string')) x(p, r)"
)
def g1_schema_of_part_types(spark, d):
    typed = m.TriplesMap(
        lambda t: t["part"].select("p_partkey", "p_size", "p_brand", F.regexp_replace("p_type", " ", "_").alias("cls")),
        iri("part", "p_partkey"), (),
        (m.obj_tpl(terms.RDF_TYPE, NS + "{cls}"), m.obj_col(NS + "size", "p_size", "integer"), m.obj_col(NS + "brand", "p_brand"))
    )
    return schema.extract_schema(graph(spark, d, [typed]))


@register("""WITH k AS (SELECT DISTINCT c_mktsegment || n_name AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), u AS (SELECT DISTINCT substr(t, 2) AS t FROM k UNION SELECT replace(t, 'A', 'AX') FROM k)
SELECT u.t AS term, k.t AS suggestion, levenshtein(lower(u.t), lower(k.t))::INT AS distance, row_number() OVER (PARTITION BY u.t ORDER BY levenshtein(lower(u.t), lower(k.t)), k.t)::INT AS rank FROM u JOIN k ON levenshtein(lower(u.t), lower(k.t)) <= 2 QUALIFY rank <= 2""")
def g14_suggested_names(spark, d):
    known = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.concat("c_mktsegment", "n_name").alias("term")).distinct()
    unknown = known.select(F.substring("term", 2, 1000).alias("term")).union(
        known.select(F.replace("term", F.lit("A"), F.lit("AX")))
    ).distinct()
    return schema.suggest(unknown, known, 2, 2)


@register(
    f"SELECT class, CASE WHEN bool_or(is_object) AND bool_or(NOT is_object) THEN 'both' WHEN bool_or(is_object) THEN 'only_object' ELSE 'only_datatype' END AS kind FROM {SCHEMA} WHERE property < 'size2' GROUP BY 1"
)
def g15_kinds_of_parts(spark, d):
    return schema.property_kind(_part_schema(spark, d).where("property < 'size2'"))


@register(
    "SELECT DISTINCT p_type AS element_id FROM part WHERE contains(lower(p_type), lower((SELECT min(split_part(p_type, ' ', 1)) FROM part)))"
)
def l1_grep_types(spark, d):
    p = table(spark, d, "part")
    word = p.agg(F.min(F.element_at(F.split("p_type", " "), 1))).first()[0]
    return linking.grep(
        p.select(F.col("p_type").alias("element_id"), F.col("p_type").alias("text"), F.lit("class").alias("type")), word.upper(), "class"
    ).select("element_id")


# linking
@register("SELECT 'customer/' || c_custkey AS s, 'segment' AS p, c_mktsegment AS o FROM customer")
def l9_triples(spark, d):
    return linking.matches_as_triples(
        table(spark, d, "customer").select(
            F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("instance"), F.lit("segment").alias("property"),
            F.col("c_mktsegment").alias("value")
        )
    ).select("triple.*")


@register("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0), x AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS item_id, v FROM e ORDER BY 1 LIMIT 500)
SELECT q.vec_id AS query_id, item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(x.v, q.v), 12) DESC, item_id)::INT AS rank FROM x, q QUALIFY rank <= 50""")
def l7_value_search(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    values = e.select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("value"), "v")
    return linking.search_values(
        values, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    ).select("query_id", "item_id", "rank")


# scoring
def _rows(spark, d, keep: str) -> DataFrame:
    o = table(spark, d, "orders").where(keep)
    return o.select(
        (F.col("o_custkey") % 50).cast("int").alias("pair"), F.col("o_orderkey").alias("row_id"),
        F.explode(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).alias("col", "value")
    )


@register("""WITH r AS (SELECT o_custkey % 50 AS pair, list_sort(list_distinct([o_orderstatus, o_orderpriority])) AS row, o_orderkey % 3 > 0 AS a, o_orderkey % 2 = 0 AS e FROM orders), c AS (SELECT pair, row, count(*) FILTER (a) AS a, count(*) FILTER (e) AS e FROM r GROUP BY ALL), t AS (SELECT pair, sum(least(a, e)) AS tp, sum(a) AS a, sum(e) AS e FROM c GROUP BY 1)
SELECT pair::INT AS pair, round(CASE WHEN a = 0 AND e = 0 THEN 1 WHEN a > 0 THEN tp / a ELSE 0 END, 4) AS precision, round(CASE WHEN a = 0 AND e = 0 THEN 1 WHEN e > 0 THEN tp / e ELSE 0 END, 4) AS recall FROM t""")
def e2_row_multiset(spark, d):
    every = _rows(spark, d, "true").select("pair").distinct()
    return scoring.score_rows(
        _rows(spark, d, "o_orderkey % 3 > 0"), _rows(spark, d, "o_orderkey % 2 = 0"), every
    ).select("pair", "precision", "recall")


@register(
    "SELECT (o_custkey % 50)::INT AS pair, col, count(DISTINCT value) AS n FROM (SELECT o_custkey, unnest(['status', 'priority']) AS col, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders) GROUP BY 1, 2"
)
def e7_column_values(spark, d):
    return scoring.column_values(_rows(spark, d, "true")).groupBy("pair", "col").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH g AS (SELECT DISTINCT o_custkey % 50 AS pair, CASE o_orderkey % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'acceptable' ELSE 'other' END AS level, o_orderpriority || (o_orderkey % 7) AS v FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT DISTINCT o_custkey % 50 AS pair, o_orderpriority || (o_orderkey % 7) AS v FROM orders WHERE o_orderkey % 5 = 1),
h AS (SELECT pair, level, count(*) AS n FROM g JOIN s USING (pair, v) GROUP BY 1, 2) SELECT pair::INT AS pair, level, n FROM h WHERE level <> 'acceptable' OR pair IN (SELECT pair FROM h WHERE level = 'preferred')""")
def e8_active_levels(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).cast("int").alias("pair"), k,
        F.when(k % 3 == 0, "preferred").when(k % 3 == 1, "acceptable").otherwise("other").alias("level"),
        F.concat("o_orderpriority", (k % 7).cast("string")).alias("value")
    )
    return scoring.active_levels(o.where(k % 2 == 0).select("pair", "level", "value"), o.where(k % 5 == 1).select("pair", "value"))


def _overlaps(spark, d) -> DataFrame:
    """Overlaps of four columns with four, all different, by customer group."""
    c = F.col
    p = table(spark, d, "part").select(
        (c("p_partkey") % 50).cast("int").alias("pair"), (c("p_partkey") % 4).cast("string").alias("gt_col"),
        (F.floor(c("p_partkey") / 4) % 4).cast("string").alias("sys_col"), c("p_partkey").alias("k")
    )
    return p.groupBy("pair", "gt_col", "sys_col").agg(F.max("k").alias("overlap"))


@register("""WITH RECURSIVE o AS (SELECT (p_partkey % 50)::INT AS pair, (p_partkey % 4)::VARCHAR AS g, (p_partkey // 4 % 4)::VARCHAR AS s, max(p_partkey) AS n FROM part GROUP BY ALL),
t AS (SELECT pair, [g] AS gs, [s] AS ss, g, s, n FROM o QUALIFY row_number() OVER (PARTITION BY pair ORDER BY n DESC, g, s) = 1
 UNION ALL SELECT pair, gs, ss, g, s, n FROM (SELECT t.pair, list_append(t.gs, o.g) AS gs, list_append(t.ss, o.s) AS ss, o.g, o.s, o.n, row_number() OVER (PARTITION BY t.pair ORDER BY o.n DESC, o.g, o.s) AS r FROM t JOIN o ON o.pair = t.pair AND NOT list_contains(t.gs, o.g) AND NOT list_contains(t.ss, o.s)) WHERE r = 1)
SELECT pair, g AS gt_col, s AS sys_col, n AS overlap FROM t""")
def e11_pairing(spark, d):
    return scoring.pair_columns(_overlaps(spark, d))


@register(
    "SELECT (o_custkey % 50)::INT AS pair, 'status' AS col, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT (o_custkey % 50)::INT, 'priority', count(*) FROM orders WHERE o_custkey % 50 % 2 > 0 GROUP BY 1"
)
def e12_without_labels(spark, d):
    labels = spark.range(0, 50, 2).select(F.col("id").cast("int").alias("pair"), F.lit("priority").alias("col"))
    return scoring.drop_bind_labels(_rows(spark, d, "true"), labels).groupBy("pair", "col").agg(F.count(F.lit(1)).alias("n"))


def _with_nulls(spark, d) -> DataFrame:
    """(pair, row) of three texts, the second and third blank in some rows."""
    k = F.col("o_orderkey")
    row = F.array(
        k.cast("string"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")),
        F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    )
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("int").alias("pair"), row.alias("row"))


_NULLS = "(SELECT (o_custkey % 50)::INT AS pair, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 4 = 0 THEN 4 ELSE 0 END AS mask FROM orders)"


@register(
    f"SELECT pair, v AS variant, count(*) FILTER (mask & v = 0) AS n FROM {_NULLS} JOIN (SELECT pair, bit_or(mask) AS nulls FROM {_NULLS} GROUP BY 1) USING (pair), (VALUES (0::BIGINT), (2), (4), (6)) x(v) WHERE v & nulls = v GROUP BY ALL HAVING n > 0"
)
def e13_null_variants(spark, d):
    return scoring.null_variants(_with_nulls(spark, d)).groupBy("pair", "variant").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH n AS {_NULLS}, s AS (SELECT pair, k FROM n WHERE CASE pair % 3 WHEN 0 THEN mask = 0 WHEN 1 THEN mask & 2 = 0 ELSE true END), v AS (SELECT pair, v, count(*) AS gt, count(s.k) AS tp FROM n CROSS JOIN (VALUES (0::BIGINT), (2), (4), (6)) x(v) LEFT JOIN s USING (pair, k) WHERE mask & v = 0 GROUP BY ALL),
f AS (SELECT v.pair, v, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (gt + c) END AS f1 FROM v LEFT JOIN (SELECT pair, count(*) AS c FROM s GROUP BY 1) USING (pair)) SELECT pair, max(f1) AS f1 FROM f GROUP BY 1""")
def e14_adaptive(spark, d):
    rows = _with_nulls(spark, d)
    blank = lambda i: F.col("row")[i] == ""
    found = rows.where(F.when(F.col("pair") % 3 == 0, ~blank(1) & ~blank(2)).when(F.col("pair") % 3 == 1, ~blank(1)).otherwise(F.lit(True)))
    return scoring.score_adaptive(scoring.null_variants(rows), found).select("pair", "f1")


@register("""WITH c AS (SELECT DISTINCT (p_partkey % 50)::INT AS pair, p_size AS col, CASE WHEN p_size % 3 = 0 THEN 'acceptable' ELSE 'preferred' END AS level, p_size % 7 AS concept, p_size % 4 > 0 AS hit FROM part), r AS (SELECT pair, avg(h) AS recall FROM (SELECT pair, concept, max(hit::INT) AS h FROM c WHERE level = 'preferred' GROUP BY 1, 2) GROUP BY 1)
SELECT pair, round(coalesce(recall, 1), 6) AS schema_recall, round(least(count(*) FILTER (hit) / (10 + pair % 5), 1), 6) AS schema_precision FROM c LEFT JOIN r USING (pair) GROUP BY pair, recall""")
def e15_schema_scores(spark, d):
    """E15, E16."""
    c = table(spark, d, "part").select(
        (F.col("p_partkey") % 50).cast("int").alias("pair"), F.col("p_size").alias("col"),
        F.when(F.col("p_size") % 3 == 0, "acceptable").otherwise("preferred").alias("level"), (F.col("p_size") % 7).alias("concept")
    ).distinct()
    n = spark.range(50).select(F.col("id").cast("int").alias("pair"), (10 + F.col("id") % 5).alias("n"))
    t = scoring.score_schema(c, c.where("col % 4 > 0").select("pair", F.col("col").alias("gt_col")), n)
    return t.select("pair", *(F.round(x, 6).alias(x) for x in ("schema_recall", "schema_precision")))


@register(
    "SELECT question_id, reading_id, n_rows, null_columns, reading_id = min(reading_id) OVER (PARTITION BY question_id) AS is_default FROM (SELECT o_custkey AS question_id, o_orderstatus AS reading_id, count(*) AS n_rows, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'b' ELSE '' END AS null_columns FROM orders GROUP BY 1, 2)"
)
def e19_ground_truth(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("reading_id"), F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("a"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("b")
    )
    cells = o.unpivot(["question_id", "reading_id", "row_id"], ["a", "b"], "col", "value")
    return scoring.build_gt(cells).withColumn("null_columns", F.array_join("null_columns", ","))


@register(
    "SELECT o_orderstatus AS question_id, o_orderpriority AS reading_id, CASE WHEN c = 'a' THEN 'preferred' ELSE 'other' END AS level, count(DISTINCT v) AS n_values, min(v) AS low, max(v) AS high FROM (SELECT o_orderstatus, o_orderpriority, unnest(['a', 'b']) AS c, unnest([(o_custkey % 100)::VARCHAR, (o_orderkey % 7)::VARCHAR]) AS v FROM orders) GROUP BY 1, 2, 3"
)
def e19_level_values(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("question_id"), F.col("o_orderpriority").alias("reading_id"), F.col("o_orderkey").alias("row_id"),
        (F.col("o_custkey") % 100).cast("string").alias("a"), (F.col("o_orderkey") % 7).cast("string").alias("b")
    )
    cells = o.unpivot(["question_id", "reading_id", "row_id"], ["a", "b"], "col", "value")
    return scoring.level_values(
        cells, cells.select("question_id", "reading_id", "col", F.when(F.col("col") == "a", "preferred").otherwise("other").alias("level"))
    )


@register("""WITH c AS (SELECT o_custkey AS question_id, o_orderkey AS candidate, CASE WHEN o_orderkey % 3 > 0 THEN 0.3 ELSE 0 END + CASE WHEN o_orderkey % 150 > 0 THEN 0.3 ELSE 0 END + CASE WHEN o_orderkey % 150 BETWEEN 1 AND 100 THEN 0.2 ELSE 0 END + 0.2 * (o_orderkey % 11) / 10 AS total FROM orders)
SELECT question_id, candidate FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(total, 9) DESC, candidate) = 1""")
def e34_select_best(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), k.alias("candidate"), F.when(k % 3 == 0, "x").alias("error"), (k % 150).alias("n_rows"),
        ((k % 11) / 10).alias("confidence")
    )
    return scoring.select_best(c).select("question_id", "candidate")


@register(
    "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 4 > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS n FROM orders GROUP BY 1"
)
def e35_status(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").groupBy(
        scoring.result_status(F.when(k % 5 == 0, "x"), k % 4).alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))


@register("""WITH s AS (SELECT o_custkey AS q, list(DISTINCT o_orderstatus) AS items FROM orders GROUP BY 1), w AS (SELECT unnest([1, 2, 3]) AS solution, unnest([['F'], ['F', 'O'], ['F', 'O', 'P', 'X']]) AS want), m AS (SELECT q, solution, len(list_intersect(items, want)) AS h, len(items) AS n, len(want) AS k FROM s, w)
SELECT q, solution FROM (SELECT *, CASE WHEN h = 0 THEN 0 ELSE 2 * h / (n + k) END AS f, h / n AS p, h / k AS r FROM m) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(f, 9) DESC, round(p, 9) DESC, round(r, 9) DESC, solution) = 1""")
def e36_best_set(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.collect_set("o_orderstatus").alias("items"))
    wanted = spark.createDataFrame([(1, ["F"]), (2, ["F", "O"]), (3, ["F", "O", "P", "X"])], "solution int, items array<string>")
    solutions = s.select(
        "q",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("solution"), F.array(*map(F.lit, w)).alias("items")) for i, w in wanted.collect()))
        ).alias("x")
    ).select("q", "x.*")
    return scoring.best_set(s, solutions).select("q", "solution")


@register("""WITH g AS (SELECT DISTINCT o_custkey % 50 AS pair, lower(o_orderstatus) AS a, o_orderkey % 9 AS b FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT DISTINCT o_custkey % 50 AS pair, lower(o_orderstatus) AS a, o_orderkey % 9 AS b FROM orders WHERE o_orderkey % 5 = 1 AND o_custkey % 50 < 40),
n AS (SELECT pair, count(*) FILTER (k = 'b') AS tp, count(*) FILTER (k <> 's') AS g, count(*) FILTER (k <> 'g') AS s FROM (SELECT coalesce(g.pair, s.pair) AS pair, CASE WHEN g.pair IS NULL THEN 's' WHEN s.pair IS NULL THEN 'g' ELSE 'b' END AS k FROM g FULL JOIN s ON g.pair = s.pair AND g.a = s.a AND g.b = s.b) GROUP BY 1)
SELECT p::INT AS pair, round(coalesce(CASE WHEN tp > 0 THEN 2 * tp / (g + s) END, 0), 6) AS f1 FROM range(60) r(p) LEFT JOIN n ON n.pair = p""")
def e37_tolerant(spark, d):
    """Numbers written differently and statuses in another case agree; questions without a result are 0."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).cast("int").alias("pair"), k.alias("row_id"), F.col("o_orderstatus").alias("a"),
        (k % 9).cast("string").alias("b")
    )
    cells = lambda df: df.unpivot(["pair", "row_id"], ["a", "b"], "col", "value")
    gt, found = o.where(k % 2 == 0), o.where((k % 5 == 1) & (F.col("pair") < 40)).withColumn("a", F.concat(F.lit(" "), F.lower("a"))).withColumn(
        "b", F.concat(F.lit("-"), "b", F.lit(".0"))
    )
    every = spark.range(60).select(F.col("id").cast("int").alias("pair"))
    return scoring.rescore_tolerant(cells(gt), cells(found), every).withColumn("f1", F.round("f1", 6))


@register(
    """WITH s AS (SELECT c_mktsegment AS v, count(*) AS a, count(*) FILTER (c_custkey % 2 = 0) AS b FROM customer GROUP BY 1) SELECT 'all' AS pair, count(*) FILTER (a = b)::BIGINT AS tp, count(*) FILTER (a <> b)::BIGINT AS fp, count(*) FILTER (a <> b)::BIGINT AS fn, false AS failed FROM s UNION ALL SELECT 'names', count(DISTINCT c_mktsegment) FILTER (c_custkey % 2 = 0), 0, count(DISTINCT c_mktsegment) - count(DISTINCT c_mktsegment) FILTER (c_custkey % 2 = 0), false FROM customer UNION ALL SELECT 'gone', 0, 0, 0, true"""
)
def e38_snapshots(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    fns = {
        "all": lambda t: t["c"].groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
        "names": lambda t: t["c"].select("c_mktsegment").distinct(), "gone": lambda t: t["c"].agg(F.max("c_acctbal") < -1e9).where("false")
    }
    return scoring.compare_snapshots(
        spark, fns, {"c": c}, {"c": c.where("c_custkey % 2 = 0").drop("c_acctbal")}
    ).select("pair", "tp", "fp", "fn", "failed")


@register(
    "SELECT 'shop' AS dataset, 'all' AS reading, count(*) AS n_rows, 'yes' AS status FROM customer UNION ALL SELECT 'shop', 'none', 0, 'partial' FROM customer HAVING count(*) > 0 UNION ALL SELECT 'other', 'wrong', -1, 'failed' FROM customer HAVING count(*) > 0"
)
def e39_readings(spark, d):
    c = table(spark, d, "customer")
    fns = {"all": lambda: c.select("c_name"), "none": lambda: c.where("c_custkey < 0"), "wrong": lambda: c.select("c_colour")}
    return scoring.check_readings(spark, fns, {"all": "shop", "none": "shop", "wrong": "other"}).select(
        "dataset", "reading", F.coalesce("n_rows", F.lit(-1)).alias("n_rows"), "status"
    )


@register("""WITH o AS (SELECT o_custkey % 50 AS run, o_orderkey AS k, 'c' || o_custkey AS a, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority ELSE '' END AS b FROM orders), p AS (SELECT run, k, a, b, unnest([1, 2]) AS reading FROM o), g AS (SELECT DISTINCT run, reading, a, b FROM p WHERE CASE reading WHEN 1 THEN k % 2 = 0 ELSE k % 3 = 0 END),
s AS (SELECT DISTINCT run, a, b FROM o WHERE k % 4 = 0 AND (run % 2 = 0 OR b <> '')), v AS (SELECT g.run, g.reading, x.v, count(*) AS n, count(s.run) AS tp FROM (VALUES (false), (true)) x(v) JOIN g ON NOT x.v OR g.b <> '' LEFT JOIN s ON s.run = g.run AND s.a = g.a AND s.b = g.b GROUP BY ALL),
f AS (SELECT run, reading, max(CASE WHEN tp > 0 THEN 2 * tp / (n + (SELECT count(*) FROM s WHERE s.run = v.run)) ELSE 0 END) AS f1 FROM v GROUP BY 1, 2) SELECT run::INT AS run_id, reading AS reading_id, round(f1, 6) AS data_f1 FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY round(f1, 12) DESC, reading) = 1""")
def e18_evaluate(spark, d):
    """Runs find customers and priorities, which the second reading expects of other orders; priorities may be blank."""
    k, run = F.col("o_orderkey"), (F.col("o_custkey") % 50).cast("int")
    o = table(spark, d, "orders").select(
        run.alias("run_id"), k.alias("row_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"),
        F.when(k % 6 > 0, F.col("o_orderpriority")).alias("b")
    )
    both = o.withColumn("reading_id", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("pair", F.struct("run_id", "reading_id"))
    cells = lambda df, a, b: df.select(
        "pair", "row_id", F.col("a").alias(a), F.col("b").alias(b)
    ).unpivot(["pair", "row_id"], [a, b], "col", "value")
    gt = cells(
        both.where(F.when(F.col("reading_id") == 1, F.col("row_id") % 2 == 0).otherwise(F.col("row_id") % 3 == 0)), "customer", "priority"
    )
    found = cells(both.where((F.col("row_id") % 4 == 0) & ((F.col("run_id") % 2 == 0) | F.col("b").isNotNull())), "x", "y")
    columns = both.select("pair").distinct().select(
        "pair",
        F.explode(
            F.array(
                *(F.struct(F.lit(c).alias("col"), F.lit("preferred").alias("level"), F.lit(c).alias("concept"), F.lit(False).alias("is_label")) for c in ("customer", "priority"))
            )
        ).alias("x")
    ).select("pair", "x.*")
    return scoring.evaluate(gt, found, columns).select("run_id", "reading_id", F.round("data_f1", 6).alias("data_f1"))


@register("""WITH RECURSIVE x AS MATERIALIZED (SELECT p_partkey % 50 AS pair, p_partkey AS k, unnest(['type', 'brand', 'size']) AS col, unnest([p_type, p_brand, p_size::VARCHAR]) AS v FROM part),
m AS MATERIALIZED (SELECT a.pair, a.k AS a, e.k AS e, count(*) AS n FROM x a JOIN x e ON a.pair = e.pair AND a.col = e.col AND a.v = e.v AND a.k % 3 > 0 AND e.k % 2 = 0 GROUP BY ALL),
r AS MATERIALIZED (SELECT pair, a, row_number() OVER (PARTITION BY pair ORDER BY a) AS i FROM (SELECT DISTINCT pair, a FROM m)),
g AS (SELECT pair, 0::BIGINT AS i, []::BIGINT[] AS taken, 0::BIGINT AS tp FROM (SELECT DISTINCT pair FROM r) UNION ALL SELECT h.pair, h.i, CASE WHEN h.best IS NULL THEN h.taken ELSE list_append(h.taken, h.best.e) END, h.tp + coalesce(h.best.n, 0)
 FROM (SELECT g.pair, r.i, g.taken, g.tp, min_by({'e': m.e, 'n': m.n}, (-m.n, m.e)) FILTER (NOT list_contains(g.taken, m.e)) AS best FROM g JOIN r ON r.pair = g.pair AND r.i = g.i + 1 JOIN m ON m.pair = r.pair AND m.a = r.a GROUP BY ALL) h),
t AS (SELECT pair, max_by(tp, i) AS tp FROM g GROUP BY pair), s AS (SELECT pair, count(*) FILTER (k % 3 > 0) AS a, count(*) FILTER (k % 2 = 0) AS e FROM x GROUP BY pair)
SELECT pair, round(CASE WHEN a > 0 THEN coalesce(tp, 0) / a ELSE 0 END, 12) AS precision, round(CASE WHEN e > 0 THEN coalesce(tp, 0) / e ELSE 0 END, 12) AS recall, round(CASE WHEN coalesce(tp, 0) > 0 THEN 2 * tp / (a + e) ELSE 0 END, 12) AS f1 FROM s LEFT JOIN t USING (pair) WHERE a + e > 0""")
def e3_cell_f1(spark, d):
    """Rows take rows greedily, one after the other."""
    cells = lambda keep: table(spark, d, "part").where(keep).select(
        (F.col("p_partkey") % 50).alias("pair"), F.col("p_partkey").alias("row_id"),
        F.explode(
            F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
        ).alias("col", "value")
    )
    t = scoring.score_cells(cells("p_partkey % 3 > 0"), cells("p_partkey % 2 = 0"))
    return t.select("pair", *(F.round(c, 12).alias(c) for c in ("precision", "recall", "f1")))


#: The ratio of a matcher of longest common blocks for the rows (a, b) of ``pairs``: the longest run that both have, first in a and then in
#: b, and the same on either side of it; m has the common runs from each two places, g the parts with their best run.
LIKENESS = """c AS MATERIALIZED (SELECT a, b, i, j, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island FROM pairs, range(length(a)) x(i), range(length(b)) y(j) WHERE a[i + 1] = b[j + 1]),
m AS MATERIALIZED (SELECT a, b, i, j, count(*) OVER (PARTITION BY a, b, i - j, island ORDER BY i DESC) AS k FROM c),
g AS (SELECT a, b, 0::BIGINT AS a0, length(a)::BIGINT AS a1, 0::BIGINT AS b0, length(b)::BIGINT AS b1, max_by({'i': i, 'j': j, 'k': k}, (k, -i, -j)) AS best FROM m GROUP BY a, b UNION ALL
 SELECT h.a, h.b, a0, a1, b0, b1, max_by({'i': i, 'j': j, 'k': least(k, a1 - i, b1 - j)}, (least(k, a1 - i, b1 - j), -i, -j)) FROM (
  SELECT a, b, CASE WHEN side = 0 THEN a0 ELSE best.i + best.k END AS a0, CASE WHEN side = 0 THEN best.i ELSE a1 END AS a1, CASE WHEN side = 0 THEN b0 ELSE best.j + best.k END AS b0, CASE WHEN side = 0 THEN best.j ELSE b1 END AS b1
  FROM g, range(2) t(side)) h JOIN m ON m.a = h.a AND m.b = h.b AND i >= a0 AND i < a1 AND j >= b0 AND j < b1 GROUP BY ALL),
likeness AS (SELECT p.a, p.b, CASE WHEN length(p.a) + length(p.b) = 0 THEN 1 ELSE 2::DOUBLE * coalesce(n, 0) / (length(p.a) + length(p.b)) END AS ratio FROM pairs p LEFT JOIN (SELECT a, b, sum(best.k) AS n FROM g GROUP BY ALL) s ON s.a = p.a AND s.b = p.b)"""


@register(f"""WITH RECURSIVE q AS (SELECT p_partkey AS question_id, p_name AS literal, string_split(lower('which ' || substr(p_name, 2) || ' are in stock'), ' ') AS ws FROM part),
w AS (SELECT DISTINCT question_id, literal, array_to_string(ws[i:i + n - 1], ' ') AS win FROM q, range(1, 5) x(n), range(1, 9) y(i) WHERE i <= len(ws) - n + 1), pairs AS MATERIALIZED (SELECT DISTINCT win AS a, lower(literal) AS b FROM w), {LIKENESS}
SELECT question_id, literal, max(ratio) AS sim, max_by(win, (ratio, win)) AS "window", max_by(win, (ratio, win))[:3] = lower(literal)[:3] AS same_prefix FROM w JOIN likeness ON a = win AND b = lower(literal) GROUP BY 1, 2""")
def l15_mentions(spark, d):
    """Part names within questions that misspell them."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), "p_name")
    return linking.mention_sim(
        p.select("question_id", F.concat(F.lit("which "), F.substring("p_name", 2, 100), F.lit(" are in stock")).alias("question")),
        p.select("question_id", F.col("p_name").alias("literal"))
    )


@register(f"""WITH RECURSIVE e AS (SELECT DISTINCT substr(p_name, 2) AS keyword, 'p_name' AS col, p_name AS value, (p_partkey % 50) / 100 + 0.5::DOUBLE AS sim FROM part), pairs AS MATERIALIZED (SELECT DISTINCT lower(keyword) AS a, lower(value) AS b FROM e), {LIKENESS},
n AS (SELECT e.*, ratio FROM e JOIN likeness ON a = lower(keyword) AND b = lower(value) WHERE ratio >= 0.3 AND sim >= 0.6)
SELECT * FROM n QUALIFY ratio >= 0.9 * max(ratio) OVER (PARTITION BY keyword, col) AND sim >= 0.9 * max(sim) OVER (PARTITION BY keyword, col)""")
def l19_entities(spark, d):
    p = table(spark, d, "part")
    cands = p.select(
        F.substring("p_name", 2, 100).alias("keyword"), F.lit("p_name").alias("col"), F.col("p_name").alias("value"),
        ((F.col("p_partkey") % 50) / 100 + 0.5).alias("sim")
    ).distinct()
    return linking.filter_entities(cands)


@register(f"""WITH RECURSIVE s AS (SELECT DISTINCT c_mktsegment AS col FROM customer), k AS (SELECT col, lower(col) || 's' AS keyword FROM s), n AS (SELECT s.col, k.keyword, rtrim(replace(replace(lower(s.col), ' ', ''), '_', ''), 's') AS a, rtrim(replace(replace(lower(k.keyword), ' ', ''), '_', ''), 's') AS b FROM s, k),
pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM n), {LIKENESS} SELECT col, keyword, ratio FROM n JOIN likeness USING (a, b) WHERE ratio >= 0.9""")
def l20_column_names(spark, d):
    """Segments as column names against nations' and segments' plurals."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("col")).distinct()
    return linking.match_columns_by_name(c, c.select(F.concat(F.lower("col"), F.lit("s")).alias("keyword")))


@register(f"""WITH RECURSIVE s AS (SELECT DISTINCT p_name AS col FROM part), k AS (SELECT DISTINCT 'x_' || col AS keyword FROM s UNION SELECT replace(col, ' ', '') || 'es' FROM s), n AS (SELECT s.col, k.keyword, rtrim(replace(replace(lower(s.col), ' ', ''), '_', ''), 's') AS a, rtrim(replace(replace(lower(k.keyword), ' ', ''), '_', ''), 's') AS b FROM s, k),
pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM n), {LIKENESS} SELECT col, keyword, ratio FROM n JOIN likeness USING (a, b) WHERE ratio >= 0.9""")
def l20_changed_names(spark, d):
    """Names of parts with another first letter or another end."""
    c = table(spark, d, "part").select(F.col("p_name").alias("col")).distinct()
    k = c.select(F.concat(F.lit("x_"), "col").alias("keyword")).union(c.select(F.concat(F.replace("col", F.lit(" "), F.lit("")), F.lit("es"))))
    return linking.match_columns_by_name(c, k.distinct())


# retrieval: readings over the schema of part types
def _readings(spark, d) -> DataFrame:
    """Questions of part types: reading 1 asks size0 of the type, reading 2 size0 and, acceptably, size1."""
    t = _part_schema(spark, d).select("class").distinct().select(F.col("class").alias("q"))
    p = lambda reading, p, o, need: t.select(
        "q", F.lit(reading).alias("reading"), F.lit("?x").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(need).alias("necessity")
    )
    parts = [
        p(1, terms.RDF_TYPE, F.col("q"), "required"), p(1, "size0", F.lit("?y"), "required"), p(2, terms.RDF_TYPE, F.col("q"), "required"),
        p(2, "size0", F.lit("?y"), "required"), p(2, "size1", F.lit("?z"), "acceptable")
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register(
    f"SELECT class AS q, 1 AS reading, class, property, \"range\", 'required' AS necessity FROM {SCHEMA} WHERE property = 'size0' UNION SELECT class, 2, class, property, \"range\", CASE WHEN property = 'size0' THEN 'required' ELSE 'acceptable' END FROM {SCHEMA} WHERE property IN ('size0', 'size1')"
)
def e24_schema_truth(spark, d):
    r = _readings(spark, d).withColumn("q", F.struct("q", "reading")).drop("reading")
    return scoring.schema_truth(r, _part_schema(spark, d)).select("q.q", "q.reading", "class", "property", "range", "necessity")


def _retrieved(spark, d) -> DataFrame:
    """Every question gets its own type's rows of size0 and size2, without those of range Brand2."""
    return _part_schema(spark, d).where("property in ('size0', 'size2') and range <> 'Brand2'").select(
        F.col("class").alias("q"), "class", "property", "range"
    )


_TRUTH = f"(SELECT class AS q, property, \"range\" AS r FROM {SCHEMA} WHERE property = 'size0')"


@register(f"""WITH g AS (SELECT q, count(*) AS need, count(*) FILTER (r <> 'Brand2') AS good FROM {_TRUTH} GROUP BY 1), t AS (SELECT class AS q, count(*) FILTER (property = 'size0') AS known, count(*) AS n_all FROM {SCHEMA} WHERE property IN ('size0', 'size2') AND "range" <> 'Brand2' GROUP BY 1),
f AS (SELECT q, CASE WHEN coalesce(known, 0) > 0 THEN least(good / known, 1) ELSE 0 END AS p, good / need AS r, CASE WHEN coalesce(n_all, 0) > 0 THEN least(good / n_all, 1) ELSE 0 END AS s FROM g LEFT JOIN t USING (q)) SELECT q, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(CASE WHEN s + r > 0 THEN 2 * s * r / (s + r) ELSE 0 END, 6) AS strict_f1 FROM f""")
def e25_triples(spark, d):
    """E25, E28, on reading 1."""
    r = _readings(spark, d).where("reading = 1").drop("reading")
    t = scoring.score_triples(scoring.schema_truth(r, _part_schema(spark, d)), _retrieved(spark, d), _ancestors(spark, d))
    return t.select("q", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "strict_f1")))


@register(f"""WITH p AS (SELECT DISTINCT class AS q, property FROM {SCHEMA}), c AS (SELECT DISTINCT class FROM {SCHEMA}), e AS (SELECT DISTINCT class, property FROM {SCHEMA} WHERE property IN ('size0', 'size2') AND "range" <> 'Brand2'),
subs AS (SELECT DISTINCT a.ancestor, s.class, s.property FROM {ANCESTORS} a JOIN {SCHEMA} s ON s.class = a.child WHERE s.property = 'size0'), n AS (SELECT ancestor, count(*) AS n, count(*) FILTER ((class, property) IN (FROM e)) AS k FROM subs GROUP BY 1)
SELECT class AS q, 1.0 * ((class, 'size0') IN (FROM e))::INT AS coherence FROM c UNION ALL SELECT ancestor, CASE WHEN k > 0 THEN k / n ELSE 0 END FROM n""")
def e26_paths(spark, d):
    """Each type's own path of size0, and those of the types above, which their subclasses answer."""
    s = _part_schema(spark, d)
    above, some = _ancestors(spark, d), s.where("property = 'size0'").select(F.col("class").alias("child")).distinct()
    classes = s.select("class").union(above.join(some, "child", "left_semi").select("ancestor")).distinct()
    paths = classes.select(F.col("class").alias("q"), "class", F.lit("size0").alias("property"), F.lit("required").alias("necessity"))
    edges = _retrieved(spark, d).select("class", "property").distinct()
    # each question is given the edges of its class and of those below it
    own = edges.select(F.col("class").alias("q"), "class", "property").unionByName(
        edges.join(above.select(F.col("child").alias("class"), F.col("ancestor").alias("q")), "class").select("q", "class", "property")
    ).distinct()
    return scoring.score_paths(paths, own, s, _ancestors(spark, d)).select("q", "coherence")


@register(f"""WITH s AS {SCHEMA}, g AS (SELECT class AS q, count(*) FILTER (property = 'size0') AS need, count(*) FILTER (property = 'size0' AND "range" <> 'Brand2') AS good FROM s WHERE property IN ('size0', 'size1') GROUP BY 1 HAVING need > 0)
SELECT q, 1 AS reading, round(CASE WHEN good > 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS precision, round(good / need, 6) AS recall, round(CASE WHEN good > 0 THEN 2 * (good / need) / (1 + good / need) ELSE 0 END, 6) AS f1 FROM g""")
def e27_best_reading(spark, d):
    """Both readings require size0 alone, so the first is reported."""
    t = scoring.score_retrieval(_readings(spark, d), _retrieved(spark, d), _part_schema(spark, d), _ancestors(spark, d))
    return t.select("q", "reading", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


# analytics
def _scored(spark, d) -> DataFrame:
    return _runs(spark, d).withColumn("f1", F.when(F.col("run_id") % 5 > 0, (F.col("run_id") % 11) / 10.0))


SCORED = "(SELECT o_orderpriority AS condition, o_orderstatus AS approach, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS f1 FROM orders)"


@register(
    f"SELECT approach, condition, count(*) AS n, round(avg(coalesce(f1, 0)), 6) AS mean_f1 FROM {SCORED} GROUP BY GROUPING SETS ((), (approach), (approach, condition))"
)
def a17_summary(spark, d):
    return analytics.summary(
        _scored(spark, d), ["f1"], [[], ["approach"], ["approach", "condition"]]
    ).withColumn("mean_f1", F.round("mean_f1", 6))


@register(f"SELECT condition, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM {SCORED} GROUP BY 1")
def a19_retrieval_summary(spark, d):
    t = analytics.summary(_scored(spark, d), ["f1"], [["condition"]], "pop")
    return t.select("condition", "n", F.round("mean_f1", 6).alias("mean_f1"), F.round("std_f1", 6).alias("std_f1"))


@register(
    f"SELECT approach, condition, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1 FROM {SCORED} GROUP BY 1, 2"
)
def a21_metrics_by(spark, d):
    """A20, A21."""
    t = analytics.summary(_scored(spark, d), ["f1"], [["approach", "condition"]], "samp")
    return t.select("approach", "condition", "n", F.round("mean_f1", 6).alias("mean_f1"), F.round("std_f1", 6).alias("std_f1"))


ERRORS = ["timeout", "syntax_error", None, "syntax_error", "other"]


def _syntax_runs(spark, d) -> DataFrame:
    k = F.col("run_id")
    return _runs(spark, d).select(
        "run_id", pick(k, ERRORS).alias("error_type"), F.when(k % 7 > 0, F.concat(F.lit("near "), "condition")).alias("initial_error"),
        (k % 3 == 0).alias("corrected"), F.array(F.concat(F.lit("bad "), "approach"), F.lit("bad")).alias("errors"),
        (k % 4).alias("iterations")
    )


SYNTAX = f"(SELECT *, coalesce(e = 'syntax_error' AND k % 7 > 0, false) AS u, k % 3 = 0 AND NOT coalesce(e = 'syntax_error' AND k % 7 > 0, false) AS c FROM (SELECT o_orderkey AS k, {pick_sql('o_orderkey', ERRORS)} AS e, o_orderpriority AS p, o_orderstatus AS a FROM orders))"


@register(
    f"SELECT error, count(*) AS n, count(DISTINCT k) AS runs FROM (SELECT k, 'near ' || p AS error FROM {SYNTAX} WHERE u UNION ALL SELECT k, unnest(['bad ' || a, 'bad']) FROM {SYNTAX} WHERE c) GROUP BY 1 ORDER BY n DESC, error LIMIT 5"
)
def a22_syntax_metrics(spark, d):
    return analytics.syntax_metrics(_syntax_runs(spark, d), 5)


@register(
    f"SELECT count(*) FILTER (c) AS corrections, round(100 * count(*) FILTER (c) / count(*), 1) AS correction_rate, (count(*) FILTER (u) + 2 * count(*) FILTER (c))::BIGINT AS errors, count(*) FILTER (u) AS uncorrected, round(avg(CASE WHEN c AND k % 4 > 0 THEN k % 4 END), 1) AS mean_iterations FROM {SYNTAX}"
)
def a22_syntax_summary(spark, d):
    return analytics.syntax_summary(_syntax_runs(spark, d))


@register("""WITH q AS (SELECT o_custkey::VARCHAR AS name, avg((o_orderkey % 11) / 10.0::DOUBLE) AS value FROM orders GROUP BY 1), p AS (SELECT o_orderpriority AS name, count(*)::DOUBLE AS value FROM orders GROUP BY 1)
SELECT name, round(value, 6) AS value, 'hardest' AS part FROM (FROM q ORDER BY q.value, name LIMIT 5) UNION ALL SELECT name, value, 'commonest' FROM (FROM p ORDER BY p.value DESC, name LIMIT 10)""")
def a27_report(spark, d):
    r = _runs(spark, d).select(
        F.col("question_id").cast("string").alias("question_id"), ((F.col("run_id") % 11) / 10.0).alias("f1"),
        F.col("condition").alias("problem")
    )
    return analytics.report(r, r).select("name", F.round("value", 6).alias("value"), "part")


# traces
@register("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def t11_once(spark, d):
    e = _events(spark, d)
    return traces.dedupe_events(e.unionByName(e.where("event_id % 3 = 0"))).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids")
    )


# reshaping
@register("SELECT c_custkey AS customer, c_name AS name FROM customer")
def h2_renamed(spark, d):
    """H2, H3."""
    return reshape.rename_table(table(spark, d, "customer").select("c_custkey", "c_name"), {"c_custkey": "customer", "c_name": "name"})


@register(
    "SELECT tbl, n FROM (SELECT unnest(['customer', 'client']) AS tbl, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'region', count(*) FROM region)"
)
def h4_consolidated(spark, d):
    both = reshape.consolidate({"customer": table(spark, d, "customer"), "region": table(spark, d, "region")}, {"customer": "client"})
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n") for n, df in both.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "SELECT c_custkey AS k, c_name AS name, row_number() OVER (ORDER BY 'http://example.org/customer/' || c_custkey) AS nr FROM customer"
)
def h7_numbered_entities(spark, d):
    return reshape.entities(
        graph(spark, d, [CUSTOMER], terms.RDF_TYPE, NS + "name"), NS + "Customer", {NS + "name": "name"}
    ).select(key("s").alias("k"), "name", "nr")


@register("""WITH n AS (SELECT count(*) AS n FROM customer), f AS (SELECT c_custkey AS k FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) <= greatest(1, (SELECT n FROM n) // 2)), o AS (SELECT o_orderkey, o_custkey, o_custkey IN (FROM f) AS one FROM orders)
SELECT 'first' AS half, 'orders->customer' AS fk, count(*) FILTER (one) AS n_joined FROM o UNION ALL SELECT 'second', 'orders->customer', count(*) FILTER (NOT one) FROM o""")
def h5_joined_halves(spark, d):
    fks = [reshape.ForeignKey("orders", "customer", "o_custkey", "c_custkey")]
    one, two = reshape.split_by_keys(
        {n: table(spark, d, n) for n in ("customer", "orders")}, fks, {"customer": "c_custkey", "orders": "o_orderkey"}
    )
    return reshape.check_joins({"first": one, "second": two}, fks)


@register(
    "SELECT CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS nation FROM customer"
)
def h9_filled(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit(" null ")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 3 > 0, F.col("c_nationkey")).alias("nation")
    )
    return reshape.fill_null_like(c)


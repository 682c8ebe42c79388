"""Queries of rules over values, columns and runs; their SQL states the rules anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import _events, _runs
from graphloom.functions import text
from graphloom.operators import analytics, linking, reshape, scoring
from graphloom.registry import register, table
from graphloom.sources import files
from graphloom.streaming import traces


def pick(k: Column, options: list[str | None]) -> Column:
    """The option of a row's number."""
    out = F.lit(options[-1])
    for i, x in enumerate(options[:-1]):
        out = F.when(k % len(options) == i, F.lit(x)).otherwise(out)
    return out


def pick_sql(k: str, options: list[str | None]) -> str:
    quoted = ["NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in options]
    return f"([{', '.join(quoted)}])[({k} % {len(options)})::INT + 1]"


# sources
@register("""WITH n AS (SELECT row_number() OVER (ORDER BY c_custkey) AS r, * FROM customer),
cells AS (SELECT 'c_custkey' AS col, r, c_custkey::VARCHAR AS v FROM n UNION ALL SELECT 'c_name', r, c_name FROM n UNION ALL SELECT 'c_mktsegment', r, c_mktsegment FROM n UNION ALL SELECT 'c_acctbal', r, c_acctbal::VARCHAR FROM n
 UNION ALL SELECT 'late text', r, CASE WHEN r % 3 = 0 THEN ' ' WHEN r <= 150 THEN r::VARCHAR ELSE 'x' || r END FROM n UNION ALL SELECT 'early text', r, CASE WHEN r = 7 THEN 'seven' ELSE r::VARCHAR END FROM n UNION ALL SELECT 'blank', r, '  ' FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY r) AS i FROM cells WHERE trim(v) <> ''),
t AS (SELECT col, bool_and(i > 100 OR TRY_CAST(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.')) AS whole, bool_and(i > 100 OR TRY_CAST(v AS DOUBLE) IS NOT NULL) AS num, max(length(v)) AS n FROM f WHERE i <= 1000 GROUP BY col)
SELECT c.col, CASE WHEN whole THEN 'INT' WHEN num THEN 'DECIMAL(15,6)' WHEN n <= 255 THEN 'VARCHAR(' || least(2 * n, 255) || ')' ELSE 'TEXT' END AS type FROM (SELECT DISTINCT col FROM cells) c LEFT JOIN t USING (col)""")
def s2_infer_types(spark, d):
    c = reshape.numbered(
        table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey", "r"
    ).orderBy("r")
    late = F.when(F.col("r") % 3 == 0, " ").when(F.col("r") <= 150, F.col("r").cast("string")).otherwise(F.concat(F.lit("x"), "r"))
    early = F.when(F.col("r") == 7, "seven").otherwise(F.col("r").cast("string"))
    return files.infer_types(
        c.select(
            "c_custkey", "c_name", "c_mktsegment", "c_acctbal", late.alias("late text"), early.alias("early text"),
            F.lit("  ").alias("blank")
        )
    ).select("col", "type")


# values and texts
@register(
    """SELECT k, CASE k % 7 WHEN 0 THEN z || '.5' WHEN 1 THEN (z * 100)::VARCHAR WHEN 2 THEN lower(p_name) WHEN 3 THEN z::VARCHAR WHEN 4 THEN rtrim(rtrim((z / 1000.0)::DECIMAL(10,3)::VARCHAR, '0'), '.') WHEN 5 THEN rtrim('-0.0' || z, '0') ELSE 'nan' END AS v FROM (SELECT p_partkey AS k, p_size::INT AS z, p_name FROM part)"""
)
def n2_norm_number(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit(" +"), z, F.lit(".5000 ")), F.concat(z, F.lit("E2")), F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" ")),
        F.concat(F.lit("00"), z, F.lit(".000")), F.concat(z, F.lit("e-3")), F.concat(F.lit("-.0"), z)
    ]
    v = F.lit("NaN")
    for i, x in enumerate(forms):
        v = F.when(k % 7 == i, x).otherwise(v)
    return table(spark, d, "part").select(k.alias("k"), text.norm_number(v).alias("v"))


@register(
    "SELECT v, count(*) AS n FROM (SELECT CASE WHEN r % 4 = 0 THEN '' WHEN r % 4 = 1 THEN printf('%.6g', abs(-(r % 1000) / 8.0)) WHEN r % 4 = 2 THEN lower('a#Line-' || l_linestatus) ELSE lower('Flag ' || l_returnflag) END AS v FROM (SELECT l_orderkey + l_linenumber AS r, * FROM lineitem)) GROUP BY v"
)
def n3_tolerant(spark, d):
    r = F.col("l_orderkey") + F.col("l_linenumber")
    v = F.when(r % 4 == 0, F.lit("  ")).when(r % 4 == 1, (-(r % 1000) / 8.0).cast("string")).when(
        r % 4 == 2, F.concat(F.lit("http://example.org/a#Line-"), "l_linestatus")
    ).otherwise(F.concat(F.lit(" Flag "), "l_returnflag"))
    return table(spark, d, "lineitem").select(text.norm_tolerant(v).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


TRIVIA = ["0", "0.0", " None ", "N/A", "nil", "TRUE", "1", "2", "0e5", "-0.00", "Unknown", "...", "---", "zero", "", "nan", "10", "0x0"]


@register(
    f"SELECT event_id, coalesce(lower(trim(v)) IN ('', 'null', 'none', 'n/a', 'na', 'nil', 'true', 'false', 'yes', 'no', '1', '0', 'unknown', 'undefined', 'other', '-', '--', '...') OR coalesce(TRY_CAST(v AS DOUBLE) = 0, false), true) AS trivial FROM (SELECT event_id, {pick_sql('event_id', TRIVIA)} AS v FROM events)"
)
def n4_trivial(spark, d):
    return table(spark, d, "events").select("event_id", text.is_trivial(pick(F.col("event_id"), TRIVIA)).alias("trivial"))


DATES = ["2020-02-30", "2020-02-28T10:30:00Z", "2021-12", "10:30:05"]


@register(f"""WITH c AS (SELECT 'key' AS col, o_orderkey::VARCHAR AS v FROM orders UNION SELECT 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION SELECT 'moment', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders UNION SELECT 'month or year', CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END FROM orders
 UNION SELECT 'year', strftime(o_orderdate, '%Y') FROM orders UNION SELECT 'priority', o_orderpriority FROM orders UNION SELECT 'slashes', strftime(o_orderdate, '%d/%m/%Y') FROM orders UNION SELECT 'sign', '-' || o_totalprice::DECIMAL(18,2) || 'e1' FROM orders UNION SELECT 'some', {pick_sql('o_orderkey', DATES)} FROM orders UNION SELECT 'more', {pick_sql('o_orderkey', DATES[1:])} FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS i FROM c)
SELECT col, CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'numeric' WHEN bool_and(try_strptime(v, ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d %H:%M:%S', '%H:%M:%S', '%Y', '%Y-%m']) IS NOT NULL) THEN 'temporal' ELSE 'none' END AS kind FROM f WHERE i <= 100 GROUP BY col""")
def n5_kinds(spark, d):
    k, day = F.col("o_orderkey"), lambda f: F.date_format("o_orderdate", f)
    columns = {
        "key": k.cast("string"), "date": day("yyyy-MM-dd"), "moment": day("yyyy-MM-dd'T'HH:mm:ss"),
        "month or year": F.when(k % 2 == 0, day("yyyy-MM")).otherwise(day("yyyy")), "year": day("yyyy"),
        "priority": F.col("o_orderpriority"), "slashes": day("dd/MM/yyyy"),
        "sign": F.concat(F.lit("-"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("e1")), "some": pick(k, DATES),
        "more": pick(k, DATES[1:]),
    }
    cells = table(spark, d, "orders").select(*(c.alias(n) for n, c in columns.items())).unpivot([], list(columns), "col", "value")
    return text.infer_kind(cells)


DATATYPES = [
    "http://www.w3.org/2001/XMLSchema#integer", None, "http://www.w3.org/2001/XMLSchema#string", "http://www.w3.org/2001/XMLSchema#double",
    None
]
LITERALS = ["12", "2020-01-05T10:00:00", "07:30:00", "x", "1234", "2020-1-5", "yes"]


@register(
    f"SELECT o_orderkey AS k, CASE WHEN t SIMILAR TO '.*(integer|decimal|float|double).*' THEN 'numeric' WHEN left(v, 8) SIMILAR TO '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}' OR left(v, 10) SIMILAR TO '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN 'temporal' ELSE 'string' END AS kind FROM (SELECT o_orderkey, {pick_sql('o_orderkey', DATATYPES)} AS t, {pick_sql('o_orderkey', LITERALS)} AS v FROM orders)"
)
def n6_literal_kind(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), text.literal_kind(pick(k, LITERALS), pick(k, DATATYPES)).alias("kind"))


QUERIES = [
    "SELECT ?a WHERE { ?a a ?c }", "select ?a where { ?a ?p ?b } order by desc(?b) limit 5",
    "SELECT (COUNT(*) AS ?n) WHERE { ?a ?p ?b } GROUP BY ?a",
    "SELECT ?a WHERE { ?a ?p ?b OPTIONAL { ?b ?q ?c } FILTER ( ! BOUND ( ?c ) ) }",
    "SELECT DISTINCT ?a { { ?a ?p ?b } UNION { ?a ?q ?b } }", "SELECT ?a { SERVICE <x> { ?a ?p ?b } MINUS { ?a ?q ?b } }",
    "SELECT ?a (SUM(?x) AS ?s) { ?a ?p ?x } GROUP BY ?a HAVING (SUM(?x) > 3) ORDER BY s LIMIT 10",
    "SELECT ?a { { SELECT ?a { ?a ?p ?b } } FILTER NOT EXISTS { ?a ?q ?c } }",
    "SELECT ?a { ?a ?p ?b OPTIONAL { ?a ?q ?c } }", "SELECT ?a ORDER BY ?a",
]


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", pick(F.col("event_id"), QUERIES).alias("query"))


ASKED = f"(SELECT event_id, {pick_sql('event_id', QUERIES)} AS query, upper({pick_sql('event_id', QUERIES)}) AS q FROM events)"


@register(f"""SELECT event_id, contains(q, 'LIMIT ') AS "limit", contains(q, 'FILTER ') AS filter, contains(q, 'GROUP BY') AS grouped, contains(q, 'ORDER BY') AS ordered, contains(q, 'DISTINCT') AS is_distinct, contains(q, 'OPTIONAL') AS has_optional, contains(q, 'UNION') AS has_union, contains(q, '{{ SELECT') AS subquery,
 (len(string_split(q, 'COUNT(')) + len(string_split(q, 'SUM(')) - 2)::INT AS n_aggregates FROM {ASKED}""")
def n7_query_features(spark, d):
    return text.query_features(_asked(spark, d)).drop("query")


MESSAGES = [
    "Read TimeOut", "Query execution time exceeded", "unfold.SQLSerializationException: x", "java.lang.NullPointerException",
    "Unsupported arbitrary length path", "Multiple entries with same key: UNION-1", "a does not appear in columnIDs", "Parse failure",
    "syntax error", "connection refused", "nullpointerexception", ""
]


@register(f"""SELECT event_id, CASE WHEN lower(m) LIKE '%timeout%' OR lower(m) LIKE '%execution time exceeded%' THEN 'TIMEOUT' WHEN m LIKE '%SQLSerializationException%' THEN 'SQL_SERIALIZATION_ERROR' WHEN m LIKE '%NullPointerException%' THEN 'INTERNAL_ERROR' WHEN m LIKE '%ArbitraryLengthPath%' OR m LIKE '%Unsupported arbitrary length path%' THEN 'UNSUPPORTED_PROPERTY_PATH'
 WHEN m LIKE '%Multiple entries with same key: UNION%' THEN 'UNION_MAPPING_BUG' WHEN m LIKE '%does not appear in columnIDs%' THEN 'COLUMN_ID_ERROR' WHEN lower(m) LIKE '%syntax%' OR lower(m) LIKE '%parse%' THEN 'SYNTAX_ERROR' ELSE 'UNKNOWN' END AS error FROM (SELECT event_id, {pick_sql('event_id', MESSAGES)} || ' in ' || event_type AS m FROM events)""")
def n8_error_class(spark, d):
    message = F.concat(pick(F.col("event_id"), MESSAGES), F.lit(" in "), "event_type")
    return table(spark, d, "events").select("event_id", text.error_class(message).alias("error"))


@register(
    f"""SELECT event_id, CASE WHEN contains(q, 'SERVICE') THEN 'VERY_HARD' WHEN contains(q, 'HAVING') OR contains(q, 'NOT EXISTS') OR contains(q, 'MINUS') OR contains(replace(q, ' ', ''), 'FILTER(!BOUND') THEN 'HARD' WHEN contains(q, 'GROUP BY') OR contains(q, 'COUNT') OR contains(q, 'SUM') OR contains(q, 'AVG') OR contains(q, 'OPTIONAL') THEN 'MEDIUM' ELSE 'SIMPLE' END AS level FROM {ASKED}"""
)
def n9_complexity(spark, d):
    return _asked(spark, d).select("event_id", text.complexity(F.col("query")).alias("level"))


@register(
    f"""SELECT event_id, regexp_extract(query, '(?i)order by (desc)?\\s*\\(?\\s*\\??([a-z]+)', 2) AS variable, CASE WHEN contains(q, 'BY DESC') THEN 'desc' ELSE 'asc' END AS direction, regexp_extract(q, 'LIMIT ([0-9]+)', 1)::INT AS n FROM {ASKED} WHERE contains(q, 'ORDER BY') AND contains(q, 'LIMIT')"""
)
def n10_ranked(spark, d):
    return _asked(spark, d).select("event_id", text.ranked(F.col("query")).alias("r")).where("r is not null").select("event_id", "r.*")


NOTES = [
    "Case variation of a name", "partial match", "SYNONYM resolved", "temporal change", "a typo", "abbreviation", "numeric filter on depth",
    "multi-step", "semantic variance", "ambiguity: who owns it", "ambiguity of active", "some ambiguity", "underspecified", "plain", ""
]
SETS = ["A", "C", "E", "D", "F", "C", "E"]


@register(f"""SELECT event_id, CASE WHEN s IN ('A', 'B') THEN 'none' WHEN s = 'D' THEN 'cross_dataset' WHEN t LIKE '%case variation%' THEN 'case_variation' WHEN t LIKE '%partial match%' THEN 'partial_match' WHEN t LIKE '%synonym%' THEN 'synonym' WHEN t LIKE '%temporal%' THEN 'temporal' WHEN t LIKE '%fuzzy%' OR t LIKE '%typo%' THEN 'fuzzy_typo'
 WHEN t LIKE '%abbreviation%' THEN 'abbreviation' WHEN t LIKE '%numeric filter%' THEN 'numeric_filter' WHEN t LIKE '%multi-step%' THEN 'multi_step' WHEN t LIKE '%semantic variance%' THEN 'semantic_variance' WHEN t LIKE '%ambiguity%' AND (t LIKE '%role%' OR t LIKE '%owns%' OR t LIKE '%responsible%') THEN 'role_ambiguity'
 WHEN t LIKE '%ambiguity%' AND t LIKE '%active%' THEN 'activity_ambiguity' WHEN t LIKE '%ambiguity%' OR t LIKE '%underspecified%' THEN 'underspecified' WHEN s = 'C' THEN 'partial_match' WHEN s = 'E' THEN 'semantic_variance' ELSE 'none' END AS ambiguity
 FROM (SELECT event_id, lower({pick_sql('event_id', NOTES)}) AS t, {pick_sql('event_id', SETS)} AS s FROM events)""")
def n11_ambiguity(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", text.ambiguity(pick(k, NOTES), pick(k, SETS)).alias("ambiguity"))


NAMES = [
    "search_classes", "grep_data_values", "find_paths", "Execute", "run_sparql", "validate_term", "CHECK_range", "sample_instances",
    "get_data", "list_datasets", "explain"
]


@register(
    f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, 'search|grep|find|retrieve') THEN 'retrieval' WHEN regexp_matches(t, 'sparql|query|execute') THEN 'sparql' WHEN regexp_matches(t, 'validate|check|verify') THEN 'validation' WHEN regexp_matches(t, 'sample|instance|data') THEN 'data_access' ELSE 'other' END AS category FROM (SELECT lower({pick_sql('event_id', NAMES)}) AS t FROM events)) GROUP BY 1"""
)
def n12_tool_category(spark, d):
    return table(spark, d, "events").select(
        text.tool_category(pick(F.col("event_id"), NAMES)).alias("category")
    ).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


TYPO_NOTES = ["Ekofisk -> Ekofsik", "blue line -> blu line; stop -> stpo", "nothing here"]
TEXTS = ["search EKOFSIK now", "ekofsikx", "the blu line", "stpo and blu line", "stop"]
_TYPOS = f"(SELECT o_custkey AS q, unnest(([['ekofsik'], ['blu line', 'stpo'], []])[(o_custkey % 3)::INT + 1]) AS typo FROM (SELECT DISTINCT o_custkey FROM orders)), c AS (SELECT o_orderkey AS run_id, o_custkey AS q, lower({pick_sql('o_orderkey', TEXTS)}) AS t FROM orders)"


def _typo_hits(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    calls = o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("question_id"), pick(F.col("o_orderkey"), TEXTS).alias("text")
    )
    return text.typo_hits(
        calls, o.select(F.col("o_custkey").alias("question_id"), pick(F.col("o_custkey"), TYPO_NOTES).alias("note")).distinct()
    )


@register(
    f"WITH n AS {_TYPOS} SELECT run_id, q AS question_id, typo, regexp_matches(t, '(^|[^a-z])' || typo || '($|[^a-z])') AS hit FROM c JOIN n USING (q)"
)
def n13_typo_hits(spark, d):
    return _typo_hits(spark, d)


@register(
    f"WITH n AS {_TYPOS} SELECT typo, count(*) FILTER (hit) AS calls, count(DISTINCT run_id) FILTER (hit) AS runs FROM (SELECT run_id, typo, regexp_matches(t, '(^|[^a-z])' || typo || '($|[^a-z])') AS hit FROM c JOIN n USING (q)) GROUP BY typo"
)
def a8_typo_reach(spark, d):
    return analytics.typo_reach(_typo_hits(spark, d))


@register(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x = xsd:string .' WHEN 1 THEN 'n xsd:string ; m xsd:string.' WHEN 2 THEN 'a xsd:string , xsd:string .' ELSE 'a1 ' || user_id || ' b' END AS v FROM events"
)
def n14_mask_literals(spark, d):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    v = F.when(k % 4 == 0, F.concat(F.lit('x = "'), "event_type", F.lit('"@en .'))).when(
        k % 4 == 1, F.concat(F.lit("n -"), u, F.lit(".5 ; m "), u, F.lit("."))
    )
    v = v.when(
        k % 4 == 2, F.concat(F.lit('a "q\\"'), u, F.lit('"^^xsd:int , '), u, F.lit(" ."))
    ).otherwise(F.concat(F.lit("a1 "), u, F.lit(" b")))
    return table(spark, d, "events").select("event_id", text.mask_literals(v).alias("v"))


# linking
PHRASES = ["cities", "boxes", "total drill depth greater than", "operated", "pass", "gas", "Stop Times", "depth", ""]
ELEMENTS = ["city", "box", "totalDrillDepth", "activeDepositOperator", "pas", "ga", "stop_time", "dept", "x", "well bores", "gases"]
_FORMS = "list_distinct([{0}] || CASE WHEN {0} LIKE '%ies' AND length({0}) > 5 THEN [left({0}, -3) || 'y'] ELSE [] END || CASE WHEN {0} LIKE '%es' AND length({0}) > 4 THEN [left({0}, -2)] ELSE [] END || CASE WHEN {0} LIKE '%s' AND length({0}) > 3 THEN [left({0}, -1)] ELSE [] END)"


@register(f"""WITH t AS (SELECT event_id AS k, regexp_replace(lower({pick_sql('event_id', PHRASES)} || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' ' || event_type END), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower({pick_sql('event_id', ELEMENTS)}), '[^a-z0-9]', '', 'g') AS y FROM events),
s AS (SELECT *, CASE WHEN x LIKE '%ing' AND length(x) > 6 THEN left(x, -3) WHEN x LIKE '%ed' AND length(x) > 5 THEN left(x, -2) WHEN x LIKE '%es' AND length(x) > 5 THEN left(x, -2) WHEN x LIKE '%s' AND length(x) > 4 THEN left(x, -1) ELSE x END AS stem FROM t)
SELECT k, CASE WHEN list_has_any({_FORMS.format('x')}, {_FORMS.format('y')}) THEN 2 WHEN length(y) >= 6 AND contains(x, y) OR length(stem) >= 5 AND contains(y, stem) THEN 1 ELSE 0 END AS score FROM s""")
def l14_phrase_score(spark, d):
    k = F.col("event_id")
    phrase = F.concat(pick(k, PHRASES), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(" "), "event_type")))
    return table(spark, d, "events").select(k.alias("k"), linking.phrase_score(phrase, pick(k, ELEMENTS)).alias("score"))


@register("""WITH c AS (SELECT DISTINCT 'c_name' AS col, c_name AS v FROM customer UNION SELECT 'segmentId', c_mktsegment FROM customer UNION SELECT 'Web_page', c_mktsegment FROM customer UNION SELECT 'c_mktsegment', c_mktsegment FROM customer UNION SELECT 'long_name', repeat(c_name, 3) FROM customer UNION SELECT 'long_text', repeat(c_name, 3) FROM customer)
SELECT col, count(*) AS n_values, sum(length(v))::BIGINT AS sum_length, NOT (col LIKE '%Id' OR contains(lower(col), 'web')) AND (contains(col, 'name') AND sum(length(v)) < 5000000 OR sum(length(v)) < 2000000 AND avg(length(v)) < 25 OR count(*) < 100) AS eligible FROM c GROUP BY 1""")
def l16_eligible_columns(spark, d):
    three = F.repeat("c_name", 3)
    c = table(spark, d, "customer").select(
        "c_name", F.col("c_mktsegment").alias("segmentId"), F.col("c_mktsegment").alias("Web_page"), "c_mktsegment",
        three.alias("long_name"), three.alias("long_text"), F.col("c_name").alias("own")
    )
    return linking.eligible_columns(c, ["OWN"]).select("col", "n_values", "sum_length", "eligible")


# scoring
@register("""WITH g AS (SELECT (o_custkey % 7)::INT AS pair, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) AS pos FROM orders), s AS (SELECT DISTINCT pair, k FROM g WHERE CASE pair WHEN 0 THEN pos <= 9 WHEN 1 THEN true WHEN 2 THEN pos > 1 WHEN 3 THEN pos <> 20 ELSE k % 11 < 10 END UNION SELECT 4, 0),
p AS (SELECT g.pair, coalesce(min(pos) FILTER (s.k IS NULL) - 1, count(*))::BIGINT AS prefix, count(*) AS n FROM g LEFT JOIN s ON s.pair = g.pair AND s.k = g.k GROUP BY 1)
SELECT pair, prefix, n, prefix > 0 AND (SELECT count(*) FROM s WHERE s.pair = p.pair) = prefix AS perfect FROM p""")
def e6_prefix(spark, d):
    o = table(spark, d, "orders").select(
        (F.col("o_custkey") % 7).cast("int").alias("pair"), F.col("o_orderkey").alias("k"),
        F.array(F.col("o_orderkey").cast("string")).alias("row")
    )
    gt = o.withColumn("pos", F.row_number().over(Window.partitionBy("pair").orderBy("k")).cast("long"))
    pair = F.col("pair")
    found = gt.where(
        F.when(pair == 0, F.col("pos") <= 9).when(pair == 1, F.lit(True)).when(pair == 2, F.col("pos") > 1).when(
            pair == 3, F.col("pos") != 20
        ).otherwise(F.col("k") % 11 < 10)
    )
    return scoring.score_prefix(gt, found.select("pair", "row").union(spark.range(1).select(F.lit(4), F.array(F.lit("0")))))


#: Four columns of a result: a text, two numbers with different properties, and trivial values.
def _columns(spark, d, keep: str) -> DataFrame:
    o = table(spark, d, "orders").where(keep).select(
        (F.col("o_custkey") % 7).cast("int").alias("pair"), F.col("o_orderpriority").alias("text"),
        (F.col("o_orderkey") % 50).cast("string").alias("a"), (F.col("o_orderkey") % 40 + 20).cast("string").alias("b"),
        F.when(F.col("o_orderkey") % 2 == 0, "0.0").otherwise("yes").alias("c")
    )
    return o.unpivot(["pair"], ["text", "a", "b", "c"], "col", "value")


def _properties(spark, a: str, b: str) -> DataFrame:
    return spark.range(7).select(
        F.col("id").cast("int").alias("pair"),
        F.explode(
            F.create_map(F.lit("a"), F.array(F.lit(a)), F.lit("b"), F.array(F.lit(b)), F.lit("text"), F.array(F.lit("t")))
        ).alias("col", "properties")
    )


_CELLS = """WITH o AS (SELECT o_custkey % 7 AS pair, o_orderkey AS k, o_orderpriority AS p FROM orders), v AS (SELECT pair, k, unnest(['text', 'a', 'b', 'c']) AS col, unnest([p, (k % 50)::VARCHAR, (k % 40 + 20)::VARCHAR, CASE WHEN k % 2 = 0 THEN '0.0' ELSE 'yes' END]) AS v FROM o),
u AS (SELECT DISTINCT pair, k % 3 > 0 AS s, k % 2 = 0 AS g, col, v FROM v WHERE v NOT IN ('0', '1', '0.0', 'yes')), m AS (SELECT pair, a.col AS gt_col, b.col AS sys_col, count(DISTINCT v) AS overlap FROM (SELECT DISTINCT pair, col, v FROM u WHERE g) a JOIN (SELECT DISTINCT pair, col, v FROM u WHERE s) b USING (pair, v) GROUP BY ALL)"""


@register(_CELLS + " SELECT * FROM m")
def e9_column_overlap(spark, d):
    return scoring.column_overlap(
        _columns(spark, d, "o_orderkey % 2 = 0"), _columns(spark, d, "o_orderkey % 3 > 0")
    ).withColumn("pair", F.col("pair").cast("long"))


@register(_CELLS + " SELECT * FROM m WHERE gt_col = sys_col OR gt_col = 'text' OR sys_col = 'text'")
def e10_blocked_overlap(spark, d):
    out = scoring.column_overlap(
        _columns(spark, d, "o_orderkey % 2 = 0"), _columns(spark, d, "o_orderkey % 3 > 0"), _properties(spark, "p", "q"),
        _properties(spark, "p", "q")
    )
    return out.withColumn("pair", F.col("pair").cast("long"))


# analytics
def _variants(spark, d) -> DataFrame:
    """Runs whose keys ask a variant of the question of the first key of their four, or that one."""
    number = F.floor(F.col("run_id") / 4).cast("string")
    return _runs(spark, d).withColumn("question_id", F.concat(pick(F.col("run_id"), ["BASE", "SYN", "TYPO", "UND"]), number))


VARIANTS = "(SELECT o_orderkey AS k, o_orderkey // 4 AS b, o_orderkey % 4 AS v, o_totalprice AS x, o_orderstatus AS m FROM orders)"


@register(f"SELECT ([NULL, 'SYN', 'TYPO'])[v::INT + 1] || b AS question_id, 'BASE' || b AS baseline_id FROM {VARIANTS} WHERE v IN (1, 2)")
def a28_baselines(spark, d):
    return analytics.baseline_of(_variants(spark, d))


@register(
    f"SELECT ([NULL, 'SYN', 'TYPO'])[a.v::INT + 1] || b AS question_id, a.m AS model, round(a.x - c.x, 4) AS delta FROM {VARIANTS} a JOIN {VARIANTS} c USING (b) WHERE a.v IN (1, 2) AND c.v = 0 AND a.m = c.m"
)
def a16_deltas(spark, d):
    r = _variants(spark, d)
    return analytics.deltas(
        r.withColumnRenamed("approach", "model"), analytics.baseline_of(r), "score"
    ).select("question_id", "model", F.round("delta", 4).alias("delta"))


KINDS = ["case_variation", "synonym", "temporal", "fuzzy_typo", "cross_dataset", "multi_step", "partial_match", "none", None]


def _judged(spark, d) -> DataFrame:
    k = F.col("run_id")
    measured = F.when(k % 3 == 0, F.array(F.lit("price"), F.lit("size"))).otherwise(F.array().cast("array<string>"))
    missing = F.when(k % 4 == 0, F.array(F.lit("size"))).otherwise(F.array(F.lit("name")))
    return _runs(spark, d).select(
        "run_id", "question_id", pick(k, KINDS).alias("ambiguity"), (k % 5).alias("n_rows"), ((k % 10) / 10.0).alias("schema_recall"),
        (k % 3).alias("n_matched"), measured.alias("measurements"), missing.alias("missing"), ((k % 11) / 10.0).alias("best_recall")
    )


PROBLEMS = f"""(SELECT run_id, ambiguity, unnest(list_filter([CASE WHEN k % 5 = 0 THEN ['empty_over_constrained', 'critical'] END, CASE WHEN k % 10 = 0 THEN ['concept_missing', 'critical'] WHEN k % 10 < 8 THEN ['concept_partial', 'major'] END,
 CASE WHEN k % 12 = 0 THEN ['measurement_missing', 'major'] END, CASE WHEN k % 11 < 7 AND k % 5 > 0 THEN [coalesce(map {{'case_variation': 'instance_case_mismatch', 'synonym': 'instance_synonym_not_resolved', 'temporal': 'instance_temporal_not_resolved', 'fuzzy_typo': 'instance_fuzzy_not_resolved', 'cross_dataset': 'cross_missing_query', 'multi_step': 'cross_missing_query'}}[ambiguity], 'low_recall'),
 CASE WHEN k % 11 < 3 THEN 'critical' ELSE 'major' END] END, CASE WHEN k % 12 = 0 THEN ['agg_missing_group_by', 'major'] END], lambda x: x IS NOT NULL)) AS p FROM (SELECT o_orderkey AS run_id, o_orderkey AS k, {pick_sql('o_orderkey', KINDS)} AS ambiguity FROM orders))"""


@register(f"SELECT run_id, p[1] AS problem, p[2] AS severity FROM {PROBLEMS}")
def a24_problems(spark, d):
    return analytics.detect_problems(_judged(spark, d)).select("run_id", "problem", "severity")


@register(
    f"SELECT ambiguity, p[1] AS problem, round(count(DISTINCT run_id) / any_value(n), 6) AS p FROM {PROBLEMS} JOIN (SELECT {pick_sql('o_orderkey', KINDS)} AS ambiguity, count(*) AS n FROM orders GROUP BY 1) USING (ambiguity) GROUP BY 1, 2"
)
def a26_correlations(spark, d):
    r = _judged(spark, d)
    return analytics.correlations(analytics.detect_problems(r), r).select("ambiguity", "problem", F.round("p", 6).alias("p"))


# traces
def _delegations(spark, d) -> DataFrame:
    k = F.col("event_id")
    e = _events(spark, d).withColumn("agent", F.col("event_type")).withColumn(
        "event_type", F.when(k % 5 < 3, "delegate").otherwise("delegate_end")
    )
    return e.withColumn("from_agent", F.concat(F.lit("a"), (k % 4).cast("string"))).withColumn(
        "reason", pick(k, ["Success", "complete", "no success today", "timeout", None])
    )


@register(f"""WITH e AS (SELECT user_id AS run_id, event_type AS agent, event_id AS k, ts, event_id % 5 < 3 AS begins, 'a' || (event_id % 4) AS f, {pick_sql('event_id', ['Success', 'complete', 'no success today', 'timeout', None])} AS r FROM events), p AS (SELECT *, lag(begins) OVER w AS b, lag(ts) OVER w AS s, lag(f) OVER w AS from_agent, lag(r) OVER w AS reason FROM e WINDOW w AS (PARTITION BY run_id, agent ORDER BY ts, k))
SELECT run_id, from_agent, agent AS to_agent, reason, (epoch_us(ts) - epoch_us(s)) / 1000.0 AS duration_ms, coalesce(contains(lower(r), 'success'), false) AS success FROM p WHERE NOT begins AND b""")
def t5_delegations(spark, d):
    return traces.delegations(_delegations(spark, d))


@register(f"""SELECT run_id, agent, tool, count(*) AS calls, sum(q) AS total_ms, round(avg(q), 4) AS mean_ms, min(q) AS low_ms, max(q) AS high_ms, count(*) FILTER (t > 0.04) AS ok, count(*) FILTER (t <= 0.04) AS errors, round(avg((t > 0.04)::INT), 6) AS success_rate, sum(n)::BIGINT AS results, count(*) FILTER (n > 3) AS useful,
 any_value(CASE WHEN regexp_matches(lower(tool), 'search|grep|find') THEN 'retrieval' WHEN regexp_matches(lower(tool), 'sparql|execute') THEN 'sparql' WHEN regexp_matches(lower(tool), 'validate|check') THEN 'validation' WHEN regexp_matches(lower(tool), 'sample|data') THEN 'data_access' ELSE 'other' END) AS category
 FROM (SELECT l_orderkey AS run_id, l_linestatus AS agent, {pick_sql('l_partkey', NAMES)} AS tool, l_quantity AS q, l_tax AS t, l_linenumber AS n FROM lineitem) GROUP BY 1, 2, 3""")
def t6_tool_usage(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("agent"), pick(F.col("l_partkey"), NAMES).alias("tool"),
        F.col("l_quantity").alias("duration_ms"), (F.col("l_tax") > 0.04).alias("success"), F.col("l_linenumber").alias("results"),
        (F.col("l_linenumber") > 3).alias("useful")
    )
    t = traces.tool_usage_by_agent(c).drop("mean_results")
    return t.withColumn(
        "success_rate", F.round("success_rate", 6)
    ).withColumn("mean_ms", F.round("mean_ms", 4)).withColumn("results", F.col("results").cast("long"))

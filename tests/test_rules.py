"""Boundary rules on small hand-made inputs."""

import json

from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.functions import terms, text
from graphloom.operators import analytics, linking, patterns, reshape, schema, scoring
from graphloom.sources import files
from graphloom.streaming import traces


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, expr_df):
    return expr_df.first()[0]


def test_terms(spark):
    df = spark.createDataFrame([("http://x/a%20b+c", "http://x#n"), (None, None)], "i string, j string")
    assert df.select(
        terms.local_value(F.col("i")), terms.local_name(F.col("j")), terms.namespace(F.col("j"))
    ).collect()[0] == ("a b+c", "n", "http://x#")
    made = spark.createDataFrame([("a b", 1), (None, 2)], "a string, b int").select(terms.from_template("http://x/{a}-{b}")).collect()
    assert [r[0] for r in made] == ["http://x/a%20b-1", None]


def test_pattern_boundaries(spark):
    g = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b"), ("b", "q", "5"), ("b", "q", "x")], "s string, p string, o string")
    assert rows(patterns.scan(g, "?x", "p", "?x")) == [("a",)]
    assert rows(patterns.where_num(patterns.scan(g, "?s", "q", "?v"), "v", ">", 1)) == [("b", "5")]
    left = spark.createDataFrame([(1, None), (2, "k")], "a int, b string")
    right = spark.createDataFrame([("k", 9)], "b string, c int")
    assert rows(patterns.optional(left, right, nullable=("b",)).na.fill("-").na.fill(0)) == [(1, "k", 9), (2, "k", 9)]
    other = spark.createDataFrame([(5,)], "z int")
    assert patterns.minus(left, other).count() == 2
    steps = patterns.Steps().add("a", left).add("b", right).join("c", "a", "b", "b")
    assert steps.results["c"].count() == 1


def test_metrics_of_empty_and_equal_results(spark):
    cells = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "x"), (2, 1, "a", "y")], "pair int, row_id int, col string, value string")
    none, pairs = cells.where("false"), spark.createDataFrame([(1,), (2,), (3,)], "pair int")
    got = {r["pair"]: r for r in scoring.score_values(cells, none, pairs).collect()}
    assert got[3]["f1"] == 1.0 and got[1]["recall"] == 1.0 and got[1]["precision"] == 0.0
    assert all(r["f1"] == 1.0 for r in scoring.score_values(cells, cells, pairs).collect())
    assert all(r["f1"] == 1.0 for r in scoring.score_rows(none, none, pairs).collect())
    assert all(r["f1"] == 1.0 for r in scoring.score_cells(cells, cells).collect())


def test_pairing_and_null_variants(spark):
    overlap = spark.createDataFrame(
        [(1, "a", "x", 5), (1, "a", "y", 4), (1, "b", "x", 4), (1, "b", "y", 1)], "pair int, gt_col string, sys_col string, overlap long"
    )
    assert rows(scoring.pair_columns(overlap).select("gt_col", "sys_col")) == [("a", "x"), ("b", "y")]
    r = spark.createDataFrame([(1, ["a", ""]), (1, ["b", "c"])], "pair int, row array<string>")
    got = scoring.null_variants(r).groupBy("variant").count().orderBy("variant").collect()
    assert [tuple(x) for x in got] == [(0, 2), (2, 1)]
    assert scoring.jaccard("a", "b") is not None


def test_null_variants_of_late_and_many_columns(spark):
    late = ["a"] * 14 + [""]
    many = [[""] * 13 + ["x"], ["a"] * 14]
    r = spark.createDataFrame([(1, late), (1, ["b"] * 15), (2, many[0]), (2, many[1])], "pair int, row array<string>")
    got = scoring.null_variants(r).cache()
    assert rows(got.where("pair = 1").groupBy("variant").count()) == [(0, 2), (1 << 14, 1)]
    assert got.where("pair = 2").select("variant").distinct().count() == 1 << 13 and got.where("pair = 2").count() == (1 << 13) + 1
    best = scoring.score_adaptive(
        got.where("pair = 1").select("pair", "variant", "row"), spark.createDataFrame([(1, ["b"] * 15)], "pair int, row array<string>")
    ).first()
    assert (best["variant"], best["f1"]) == (1 << 14, 1.0)


def test_prefix_and_topn(spark):
    gt = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["b"]), (1, 3, ["c"])], "pair int, pos int, row array<string>")
    sys = spark.createDataFrame([(1, ["a"]), (1, ["c"])], "pair int, row array<string>")
    assert scoring.score_prefix(gt, sys).first()[:4] == (1, 1, 3, False)
    assert scoring.score_prefix(gt, gt.select("pair", "row")).first()["perfect"]
    assert scoring.score_prefix(gt, gt.where("pos < 3").select("pair", "row")).first()[:4] == (1, 2, 3, True)
    assert scoring.score_prefix(gt, gt.where("pos > 1").select("pair", "row")).first()[:4] == (1, 0, 3, False)


def test_vote_and_agreement(spark):
    r = spark.createDataFrame(
        [(1, 1, "long text", "f"), (1, 2, "short", "f"), (1, 3, "x", "g")],
        "question_id int, candidate int, text string, fingerprint string"
    )
    assert scoring.vote(r).first()["candidate"] == 2
    a = scoring.agreement(r.withColumn("ok", F.lit(True)).withColumn("n_rows", F.lit(1))).first()
    assert abs(a["confidence"] - (0.3 + 0.5 * 2 / 3 + 0.2)) < 1e-9


def test_texts(spark):
    df = spark.createDataFrame([(" Ab ", "1.500", "-0.0000012345"), ("é", "x", "HTTP")], "a string, b string, c string")
    assert [r[0] for r in df.select(text.norm_text(F.col("a"), nfc=True)).collect()] == ["ab", "é"]
    assert [r[0] for r in df.select(text.norm_number(F.col("b"))).collect()] == ["1.5", "x"]
    assert [r[0] for r in df.select(text.norm_tolerant(F.col("c"))).collect()] == ["1.2345e-06", "http"]
    assert [r[0] for r in df.select(text.expand_camel(F.lit("fooBar"))).collect()][0] == "foo Bar"
    q = spark.createDataFrame([("SELECT ?x { ?x a ?y } ORDER BY DESC(?n) LIMIT 5",)], "query string")
    assert q.select(text.ranked(F.col("query")).alias("r")).first()["r"] == ("n", "desc", 5)
    assert text.query_features(q).first()["limit"] and text.query_features(q).first()["ordered"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.error_class(F.lit("Read Timeout"))) == "TIMEOUT" and one(text.error_class(F.lit(None).cast("string"))) == "UNKNOWN"
    assert [
        one(text.norm_number(F.lit(x))) for x in (" ABC ", "0.00", "-0.0", "1E3", "+007", ".5", "5.", "1e-3", "-Inf", "")
    ] == ["abc", "0", "-0", "1000", "7", "0.5", "5", "0.001", "-infinity", ""]
    assert one(
        text.mask_literals(F.lit('a 5 ; b 2.5 , c "x"@en , d "1"^^xsd:int .'))
    ) == "a xsd:string ; b xsd:string , c xsd:string , d xsd:string ."


def test_kinds_of_columns(spark):
    """Known answers: plain numbers, exponents, dates, times, years with months, mixed columns."""
    columns = {
        "a": ["10", "20", "3.14"], "b": ["-5", "0", "1e10"], "c": ["2020-01-15", "2021-06-30"], "d": ["2020-01-15t10:30:00".upper()],
        "e": ["00:04:51", "12:30:45"], "f": ["2020", "2021"], "g": ["hello", "world"], "h": ["10", "hello"], "i": ["2020-01-15", "hello"],
        "j": ["", "  ", "10"], "k": ["2020-01", "2020"], "l": ["2020-02-30"], "m": ["2020-01-15T10:30:00Z"], "n": ["15/01/2020"],
        "o": [" ", None],
    }
    cells = spark.createDataFrame([(c, v) for c, vs in columns.items() for v in vs], "col string, value string")
    assert dict(map(tuple, text.infer_kind(cells).collect())) == dict(
        zip(
            "abcdefghijklmn",
            ["numeric", "numeric", "temporal", "temporal", "temporal", "numeric", "none", "none", "none", "numeric", "temporal", "none", "temporal", "none"],
            strict=True
        )
    )


def test_signatures(spark):
    """Known answers: like columns 1, other properties 0, SUM for COUNT by inner predicates, contexts break ties."""
    kind = terms.RDF_TYPE
    patterns = [
        ("1", "?d", kind, "Deposit"), ("1", "?d", "name", "?x"), ("1", "?d", "size", "?n"), ("1", "?c", kind, "Company"),
        ("1", "?c", "name", "?y"),
        ("2", "?e", kind, "Deposit"), ("2", "?e", "name", "?x"), ("2", "?e", "size", "?n"), ("2", "?e", "owner", "?c"),
    ]
    projections = [
        ("1", "d", None, [], None), ("1", "x", None, [], None), ("1", "y", None, [], None), ("1", "t", "SUM", ["n"], None),
        ("2", "e", None, [], None), ("2", "x", None, [], None), ("2", "u", "COUNT", ["n"], None), ("2", "w", "AVG", ["n"], "COUNT")
    ]
    projections = [(q, f"?{v}", a, [f"?{i}" for i in inner], n) for q, v, a, inner, n in projections]
    got = scoring.signatures(
        spark.createDataFrame(patterns, "query_id string, s string, p string, o string"),
        spark.createDataFrame(projections, "query_id string, variable string, agg string, inner array<string>, nested string")
    ).cache()
    by = {(r["query_id"], r["variable"]): r for r in got.collect()}
    assert by["1", "?d"]["types"] == ["Deposit"] and by["1", "?d"]["out_predicates"] == ["name", "size"] and by["1", "?x"]["in_predicates"] == ["name"]
    assert by["1", "?x"]["subject_context"] == [
        "out:name", "out:size", "type:Deposit"
    ] and by["2", "?w"]["inner_predicates"] == ["_nested_COUNT", "size"]
    side = lambda q: got.where(F.col("query_id") == q).withColumn("pair", F.lit(1))
    found = {(r["gt_col"], r["sys_col"]): round(r["sim"], 4) for r in scoring.match_signatures(side("1"), side("2")).collect()}
    assert found == {("?x", "?x"): round(0.7 + 0.3 * 3 / 4, 4), ("?d", "?e"): 1.0, ("?t", "?u"): 1.0}
    aggregated = scoring.signature_sim(
        side("1").select(*(F.col(c).alias(f"a_{c}") for c in got.columns)).crossJoin(side("2").select(*(F.col(c).alias(f"b_{c}") for c in got.columns))).where(
            "a_agg = 'SUM' and b_agg = 'AVG' or a_variable = '?x' and b_agg is not null"
        )
    )
    assert {r["sim"] for r in aggregated.collect()} == {0.0}

def test_closure_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert schema.closure(edges).count() == 6
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r["component"] for r in schema.components(links).collect()} == {1, 100}


def test_components_of_all_orders(spark, sf_dir, tmp_path):
    orders, lines = [(k, k // 3) for k in range(600)], [(k, 1000 * (k // 60) + k % 7) for k in range(600) for _ in range(2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")

    def union_find(links):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in links:
            low, high = sorted((root(a), root(b)))
            up[high] = low
        return {x: root(x) for x in up}

    for d in (str(tmp_path), sf_dir):
        got = {r["node"]: r["component"] for r in catalog.queries()["g10_components_all"](spark, d).collect()}
        o = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{d}/orders.parquet").collect()}
        assert got == union_find(
            {(o[r["l_orderkey"]], 1_000_000 + r["l_suppkey"]) for r in spark.read.parquet(f"{d}/lineitem.parquet").collect() if r["l_orderkey"] in o}
        )


def test_lsh_takes_all_values(spark, sf_dir):
    names = {r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect()}
    grams = {n: {n.lower()[i : i + 3] for i in range(max(1, len(n) - 2))} for n in names}
    got = catalog.queries()["l17_lsh_values"](spark, sf_dir).collect()
    assert {r["keyword"] for r in got} == names
    assert all(
        abs(
            r["jaccard"] - len(grams[r["keyword"]] & grams[r["value"]]) / len(grams[r["keyword"]] | grams[r["value"]])
        ) < 0.05 and r["jaccard"] >= 0.01 for r in got
    )


def test_whole_queries_take_more_with_size(spark, sf_dir):
    q = catalog.queries()
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert q["l3_vector_topk_hundredth"](spark, sf_dir).select("query_id").distinct().count() == n
    assert q["e5_tied_topn_brands"](spark, sf_dir).where("tp < gt").count() > 0


def test_vector_ties_go_to_the_smaller_item(spark):
    items = spark.createDataFrame(
        [(i, [1.0 + i % 3, 2.0 + 2 * (i % 3)]) for i in range(200, 0, -1)], "item_id long, v array<double>"
    ).coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, v array<double>")
    assert rows(linking.vector_topk(q, items, 3).select("rank", "item_id")) == [(1, 1), (2, 2), (3, 3)]
    values = items.select(F.format_string("v%03d", "item_id").alias("value"), "v")
    assert rows(linking.search_values(values, q, 2).select("rank", "item_id")) == [(1, "v001"), (2, "v002")]


def test_vector_scores_are_held_in_blocks(spark, monkeypatch):
    vectors = [(i, [float(i * 7 % 11), float(i * 5 % 13), 1.0]) for i in range(60)]
    items = spark.createDataFrame(vectors, "item_id long, v array<double>")
    q = spark.createDataFrame(vectors[:20], "query_id long, v array<double>")
    whole = rows(linking.vector_topk(q, items, 4).select("query_id", "rank", "item_id"))
    for most in (7, 150):
        monkeypatch.setattr(linking, "SCORES", most)
        assert rows(linking.vector_topk(q, items, 4).select("query_id", "rank", "item_id")) == whole


def test_linking(spark):
    parts = linking.keyword_parts(spark.createDataFrame([(1, "a b=c")], "id int, keyword string"))
    assert {r["part"] for r in parts.collect()} == {"a b=c", "a", "b=c", "c"}
    pairs = spark.createDataFrame(
        [("cities", "city"), ("total drill depth greater than", "totalDrillDepth"), ("operated", "activeDepositOperator"), ("order", "orderline"), ("ab", "cd"), ("pass", "pas")],
        "a string, b string"
    )
    assert [r[0] for r in pairs.select(linking.phrase_score(F.col("a"), F.col("b"))).collect()] == [2, 1, 1, 1, 0, 2]
    q = spark.createDataFrame([(1, "Which ports are in Rotterdam today")], "question_id int, question string")
    best = linking.mention_sim(q, spark.createDataFrame([(1, "Roterdam")], "question_id int, literal string")).first()
    assert best["window"] == "rotterdam" and best["same_prefix"] is False or best["sim"] > 0.9


def test_analytics(spark):
    r = spark.createDataFrame(
        [("SYN01", "m", 1.0), ("BASE01", "m", 0.25), ("UND01", "m", 0.5)], "question_id string, model string, f1 double"
    )
    assert analytics.deltas(r, analytics.baseline_of(r), "f1").first()["delta"] == 0.75
    s = spark.createDataFrame([("a", "q1", 1.0)], "c string, question_id string, f1 double")
    assert analytics.cell_stats(s, ["c"], "f1").first()["se"] == 0.0


def test_reshape(spark):
    df = spark.createDataFrame([("NULL", None), ("x", 3)], "a string, b int")
    assert rows(reshape.fill_null_like(df)) == [("", 0), ("x", 3)]
    t = {"p": spark.range(1, 12).withColumnRenamed("id", "k"), "c": spark.range(1, 30).selectExpr("id", "id % 11 + 1 as k")}
    one, two = reshape.split_by_keys(t, [reshape.ForeignKey("c", "p", "k", "k")], {"p": "k", "c": "id"})
    assert one["p"].count() == 5 and one["c"].count() + two["c"].count() == 29


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a b;c-d\n1; \n2;x\n")
    df = files.read_csv_loose(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a_b", "c_d"] and rows(df.select("c_d").where("c_d is null")) == [(None,)]
    assert dict(r[:2] for r in files.infer_types(df).collect()) == {"a_b": "INT", "c_d": "VARCHAR(2)"}
    late = spark.createDataFrame([(str(i) if i < 150 else "zeta", None) for i in range(151)], "v string, w string").coalesce(1)
    assert sorted(map(tuple, files.infer_types(late).collect())) == [("v", "INT", 4), ("w", "TEXT", 0)]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "1.json").write_text(json.dumps({"run_id": "r", "question_id": "q"}))
    (runs / "2.json").write_text("{broken")
    (runs / "3.json").write_text(json.dumps({"run_id": "r"}))
    good, bad = files.read_runs(spark, str(runs), "run_id string, question_id string")
    assert good.count() == 1 and {r["reason"]: r["n"] for r in bad.collect()} == {"unreadable": 1, "incomplete": 1}
    g = spark.createDataFrame(
        [("s", "http://p", "o", "iri", None, None)], "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
    )
    files.write_triples(g, str(tmp_path / "g"))
    assert rows(files.read_triples(spark, str(tmp_path / "g")).select("s", "p", "o")) == [("s", "http://p", "o")]


EVENTS = [
    (1, "r", "2024-01-01 00:00:00", "phase_start", "plan", None), (2, "r", "2024-01-01 00:00:05", "phase_start", "act", None),
    (3, "r", "2024-01-01 00:00:09", "phase_end", "act", 3500.0), (3, "r", "2024-01-01 00:00:09", "phase_end", "act", 3500.0)
]


def events(spark):
    return spark.createDataFrame(
        EVENTS, "event_id long, run_id string, ts string, event_type string, phase string, duration_ms double"
    ).withColumn("ts", F.to_timestamp("ts"))


def test_phases(spark):
    e = traces.dedupe_events(events(spark))
    assert rows(traces.phase_intervals(e).select("phase", "duration_ms")) == [("act", 3500.0), ("plan", 5000.0)]


def test_streams(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    for name, df in (("phases", traces.phase_intervals_stream(traces.dedupe_events(stream), None)), ("rates", traces.event_rates(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option(
            "checkpointLocation", str(tmp_path / name)
        ).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    hand = [
        (1, "r", "2024-01-01 00:00:00", "delegate", "x", "m", "why"), (2, "r", "2024-01-01 00:00:02", "delegate", "x", "n", "again"),
        (3, "r", "2024-01-01 00:00:05", "delegate_end", "x", None, "SUCCESS"),
        (4, "r", "2024-01-01 00:00:06", "delegate_end", "x", None, "success"), (5, "r", "2024-01-01 00:00:07", "delegate", "y", "m", None)
    ]
    handed = spark.createDataFrame(
        hand, "event_id long, run_id string, ts string, event_type string, agent string, from_agent string, reason string"
    ).withColumn("ts", F.to_timestamp("ts"))
    handed.write.parquet(str(tmp_path / "hand"))
    q = traces.delegations_stream(
        spark.readStream.schema(handed.schema).parquet(str(tmp_path / "hand"))
    ).writeStream.format("memory").queryName("handed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("handed")) == rows(traces.delegations(handed)) == [("r", "n", "x", "again", 3000.0, True)]
    got = {r["phase"]: r["duration_ms"] for r in spark.table("phases").collect()}
    assert got == {"plan": 5000.0, "act": 4000.0}


def test_parts_of_a_graph_grow_with_its_edges(spark, monkeypatch):
    """A part of a graph has a bounded number of edges; rows without one end and loops keep their nodes, the session its number of parts."""
    monkeypatch.setattr(schema, "PART_EDGES", 100)
    chains = spark.range(1000).selectExpr("id AS a", "IF(id % 10 = 9, id, id + 1) AS b")
    odd = spark.createDataFrame([(5000, 5000), (None, 6000)], "a long, b long")
    found = schema.components(chains.union(chains).union(odd))
    want = {i: i // 10 * 10 for i in range(1000)} | {5000: 5000, 6000: 6000, None: None}
    assert {r["node"]: r["component"] for r in found.collect()} == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    made = []
    monkeypatch.setattr(schema, "cut", lambda df, plain=schema.cut: made.append(plain(df)) or made[-1])
    schema.components(chains)
    assert made[1].rdd.getNumPartitions() == 20

"""Evaluation at its gates and boundaries, and normal forms at their edges."""

from pyspark.sql import functions as F

from graphloom.functions import terms, text
from graphloom.operators import schema, scoring


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def ranked(spark, data):
    return spark.createDataFrame(
        [(p, [str(x) for x in r], float(s) if s is not None else None) for p, r, s in data], "pair string, row array<string>, score double"
    )


def test_topn_at_the_boundary_and_without_scores(spark):
    gt = ranked(
        spark, [("a", [1], 9), ("a", [2], 5), ("a", [3], 5), ("a", [4], None), ("b", ["x"], None), ("b", ["y"], None), ("c", [1], 3)]
    )
    sys = ranked(
        spark,
        [("a", [1], 9), ("a", [7], 5), ("a", [8], 5), ("a", [9], 5), ("a", [10], None), ("b", ["x"], None), ("b", ["z"], 4), ("d", [1], 1)]
    )
    found = {r.pair: (r.tp, round(r.precision, 6), round(r.recall, 6)) for r in scoring.score_topn(gt, sys).collect()}
    assert found == {"a": (3, 0.6, 1.0), "b": (1, 0.5, 0.5), "c": (0, 0.0, 0.0)}
    low = {
        r.pair: r.tp for r in scoring.score_topn(
            gt.withColumn("score", -F.col("score")), sys.withColumn("score", -F.col("score")), descending=False
        ).collect()
    }
    assert low == {"a": 3, "b": 1, "c": 0}


def cells(spark, data):
    out = []
    for (run, reading), table in data.items():
        for i, row in enumerate(table):
            out += [((run, reading), i, c, v) for c, v in row.items()]
    return spark.createDataFrame(out, "pair struct<run_id string, reading_id int>, row_id int, col string, value string")


COLUMNS = [("1name", "preferred", "name", False), ("2score", "preferred", "score", False), ("3note", "acceptable", "note", False)]


def judged(spark, gt, sys, **more):
    columns = spark.createDataFrame(
        [(p, *c) for p in gt for c in COLUMNS],
        "pair struct<run_id string, reading_id int>, col string, level string, concept string, is_label boolean"
    )
    return {r.run_id: r for r in scoring.evaluate(cells(spark, gt), cells(spark, sys), columns, **more).collect()}


def test_a_run_with_only_acceptable_values_finds_nothing(spark):
    truth = [{"1name": "ann", "2score": "12", "3note": "tall"}, {"1name": "bob", "2score": "11", "3note": "short"}]
    gt = {(run, 1): truth for run in ("only", "preferred", "none", "both")}
    sys = {
        ("only", 1): [{"n": "tall"}, {"n": "short"}],
        ("preferred", 1): [{"a": "ann"}, {"a": "bob"}],
        ("none", 1): [{"a": "x"}],
        ("both", 1): [{"a": "ann", "n": "tall", "s": "12"}, {"a": "bob", "n": "short", "s": "11"}, {"a": None, "n": None, "s": None}],
    }
    found = judged(spark, gt, sys)
    assert {
        k: (round(r.data_f1, 6), round(r.schema_recall, 6), round(r.schema_precision, 6)) for k, r in found.items()
    } == {"only": (0, 0, 0), "preferred": (1, 0.5, 1), "none": (0, 0, 0), "both": (1, 1, 1)}


def test_ranked_runs_tolerate_ties(spark):
    gt = {
        ("r", 1): [{"1name": "ann", "2score": "9"}, {"1name": "bob", "2score": "5"}],
        ("s", 1): [{"1name": "ann", "2score": "9"}, {"1name": "bob", "2score": "5"}],
        ("t", 1): [{"1name": "ann", "2score": "2"}, {"1name": "bob", "2score": "5"}]
    }
    sys = {
        ("r", 1): [{"n": "ann", "v": "9"}, {"n": "cat", "v": "5"}], ("s", 1): [{"n": "ann", "v": "9"}, {"n": "cat", "v": "5"}],
        ("t", 1): [{"n": "ann", "v": "2"}, {"n": "cat", "v": "5"}]
    }
    order = spark.createDataFrame(
        [(("r", 1), "2score", True), (("t", 1), "2score", False)],
        "pair struct<run_id string, reading_id int>, col string, descending boolean"
    )
    assert {k: round(r.data_f1, 6) for k, r in judged(spark, gt, sys, order=order).items()} == {"r": 1.0, "s": 0.5, "t": 1.0}


def test_ranges_rise_to_parents_of_classes_at_any_depth(spark):
    s = spark.createDataFrame(
        [("Bachelor", "mentor", "Senior", True), ("Senior", "age", "integer", False), ("Junior", "age", "integer", False), ("Alone", "knows", "Junior", True)],
        "class string, property string, range string, is_object boolean"
    )
    edges = spark.createDataFrame(
        [("Bachelor", "Learner"), ("Senior", "Educator"), ("Mid", "Educator"), ("Junior", "Mid"), ("Alone", "Single")],
        "child string, parent string"
    )
    assert rows(schema.lift_schema(s, edges)) == sorted(
        [("Learner", "mentor", "Educator", True), ("Educator", "age", "integer", False), ("Mid", "age", "integer", False), ("Single", "knows", "Junior", True)],
        key=str
    )


def test_white_space_of_any_kind_is_stripped_before_composing(spark):
    raw = ["\tA b\n", " É ", "é ", "\x1c x\x85", "", None, " \n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    assert [r[1] for r in rows(df.select("i", text.norm_text(F.col("v"), nfc=True)))] == ["a b", "é", "é", "x", "", None, ""]


def test_templates_keep_unreserved_signs_only(spark):
    df = spark.createDataFrame([("a b~c*d-e._f/g+h%",)], "x string")
    assert df.select(terms.from_template("http://n/{x}")).first()[0] == "http://n/a%20b~c%2Ad-e._f%2Fg%2Bh%25"


def test_best_of_totals_that_are_equal_but_for_rounding(spark):
    """In doubles 0.3 + 0.2 + 0.2 * 0.9 is more than 0.3 + 0.3 + 0.2 * 0.4."""
    cands = spark.createDataFrame(
        [("q", 1, None, 103, 0.4), ("q", 2, "x", 9, 0.9), ("r", 1, "x", 9, 0.9), ("r", 2, None, 103, 0.4), ("s", 1, "x", 9, 0.9), ("s", 2, None, 103, 0.5)],
        "question_id string, candidate long, error string, n_rows long, confidence double"
    )
    assert {r["question_id"]: r["candidate"] for r in scoring.select_best(cands).collect()} == {"q": 1, "r": 1, "s": 2}

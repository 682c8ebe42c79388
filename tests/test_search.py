"""Substring index, edit-distance join, banded MinHash and name matching against plain versions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graphloom import sizes
from graphloom.operators import edits, linking, minhash, schema, substrings


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = [
    "Banana bread", "banana", "Ananas", "aaaa", "ab", "a", "", None, "naïve café", "x" * 300 + "needle" + "y" * 300, "banana", "ÄÖÜ",
    "100%_[a]"
]
TERMS = ["anan", "ANA", "a", "ab", "b", "needle", "aaa", "aaaaa", "fé", "é", "zzz", "", None, "äö", "%_[", "d", "ad"]


def test_substring_index_finds_what_contains_does(spark, tmp_path):
    index = substrings.build_index(spark.createDataFrame([(t, 1) for t in TEXTS], "text string, term int"), str(tmp_path / "i"))
    found = substrings.search(index, spark.createDataFrame([(t, "x") for t in [*TERMS, "anan"]], "term string, text string"))
    want = {(t, x) for t in TERMS if t for x in TEXTS if x is not None and t.lower() in x.lower()}
    assert rows(found) == sorted(want, key=str)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert rows(
        substrings.search(substrings.open_index(spark, str(tmp_path / "i")), spark.createDataFrame([("ban",)], "term string"))
    ) == [("ban", "Banana bread"), ("ban", "banana")]
    none = substrings.build_index(spark.createDataFrame([], "text string"), str(tmp_path / "none"))
    assert substrings.search(none, spark.createDataFrame([("ban",)], "term string")).count() == 0


def test_searches_on_the_index(spark, tmp_path):
    e = spark.createDataFrame(
        [(1, "class", "Full professor"), (2, "class", "Professor"), (3, "property", "professor of"), (1, "class", "Full professor")],
        "element_id int, type string, text string"
    )
    index = substrings.build_index(e, str(tmp_path / "e"))
    terms = spark.createDataFrame([("PROF",), ("l p",)], "term string")
    assert rows(linking.grep_terms(e, terms, index, "class").select("term", "element_id")) == [("PROF", 1), ("PROF", 2), ("l p", 1)]
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "D"), ("C", "D")], "child string, parent string")
    found = linking.with_hierarchy(spark.createDataFrame([("A", 1), ("C", 2), ("Z", 3)], "element_id string, n int"), edges)
    assert rows(found.drop("n")) == [("A", ["B", "D"], ["B", "D", "C"], [], 3), ("C", ["D"], ["D"], ["B"], 1), ("Z", [], [], [], 0)]
    t = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    g = [
        (f"s{i}", "p", f"value {i:03d}", "literal", None, None) for i in range(600)
    ] + [(f"s{i}", t, "C", "iri", None, None) for i in range(600)]
    g = spark.createDataFrame(g, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    assert rows(linking.grep_values(g, "C", "p", "^VALUE 59[89]$")) == [("value 598",), ("value 599",)]
    values = substrings.build_index(g.where("p = 'p'"), str(tmp_path / "v"), "o")
    assert rows(
        linking.grep_values_terms(g, "C", "p", spark.createDataFrame([("UE 59",)], "term string"), values, 2)
    ) == [("UE 59", "value 590"), ("UE 59", "value 591")]
    met = linking.search_instances(g.withColumn("dataset", F.lit("d")), spark.createDataFrame([("lue 00",), ("lu",)], "term string"))
    assert rows(met) == [("d", "lue 00", 10, "s0")]
    assert "NestedLoop" not in plan(met)


def test_searches_deal_rows_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizes, "PART_ROWS", 64)
    names = [f"customer{i:05d}" for i in range(300)]
    index = substrings.build_index(spark.createDataFrame([(n,) for n in names], "text string"), str(tmp_path / "i"))
    by_file = [r["count"] for r in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert sum(by_file) > 40 * 64 and max(by_file) < 6 * 64
    terms = [f"{i:04d}" for i in range(40)]
    found = substrings.search(index, spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(t, n) for t in terms for n in names if t in n}
    assert rows(found) == sorted(want)
    # what meets are the terms' texts, no more, and they are dealt by their number
    assert found.rdd.getNumPartitions() == sizes.parts(len(want)) > 4


def test_literals_of_a_text_are_counted_once(spark):
    kinds = ["Steel", "steelworks", "tin", "Tin steel"]
    g = [(f"s{i:03d}", "p", kinds[i % 4 if i % 5 else 0], "literal" if i % 7 else "iri", f"d{i % 3}") for i in range(300)]
    terms = ["TEE", "teel", "steelw", "tin", "in s", "none", "ti"]
    want = {}
    for s, _, o, kind, dataset in g:
        for t in terms:
            if kind == "literal" and len(t) > 2 and t.lower() in o.lower():
                n, first = want.get((dataset, t), (0, s))
                want[dataset, t] = n + 1, min(first, s)
    graph = spark.createDataFrame(g, "s string, p string, o string, o_kind string, dataset string")
    met = linking.search_instances(graph, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert rows(met) == sorted((*k, *v) for k, v in want.items())


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_segments_lose_no_pair(spark, most):
    draw = random.Random(most)
    base = ["".join(draw.choices("abcd", k=draw.randint(0, 14))) for _ in range(50)]

    def changed(x):
        for _ in range(draw.randint(0, most + 1)):
            i = draw.randint(0, len(x))
            x = draw.choice([x[:i] + x[i + 1 :], x[:i] + draw.choice("abcde") + x[i:], x[:i] + draw.choice("abcde") + x[i + 1 :]])
        return x

    other = [changed(x) for x in base] + ["", "e"]
    a = spark.createDataFrame([(x,) for x in [*set(base), None]], "x string")
    b = spark.createDataFrame([(y,) for y in [*set(other), None]], "y string")
    want = sorted({(x, y, distance(x, y)) for x in set(base) for y in set(other) if distance(x, y) <= most}, key=str)
    found = edits.within(a, b, "x", "y", most)
    assert rows(found) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_segments_make_few_candidates(spark):
    draw = random.Random(1)
    names = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=14)) for _ in range(400)]
    a = spark.createDataFrame([(n[1:],) for n in names], "x string")
    b = spark.createDataFrame([(n,) for n in names], "y string")
    met = edits.candidates(a, b, "x", "y", lambda _: F.lit(2), lambda n: n + 2).count()
    assert 400 <= met < 4_000  # of 160,000 pairs within two letters of length
    assert schema.suggest(a.withColumnRenamed("x", "term"), b.withColumnRenamed("y", "term"), 2, 1).count() == 400


def test_names_with_a_ratio_lose_no_pair(spark):
    draw = random.Random(2)
    names = ["customer_name", "Name", "names", "", "s", "ab", "order date", "orderdates", "zip", None, "n_nationkey", "nation key"]
    names += ["".join(draw.choices("ab_ s", k=draw.randint(1, 12))) for _ in range(60)]
    keys = [
        "x_customer_name", "NAME", "order_date", "zips", "", "nationkeys", "Abab"
    ] + [n[1:] for n in names if n] + [n + "a" for n in names if n]
    plain = lambda x: x.lower().replace(" ", "").replace("_", "").rstrip("s")
    sim = lambda c, k: SequenceMatcher(None, plain(c), plain(k)).ratio()
    for least in (0.9, 0.6):
        want = {(c, k) for c in names if c is not None for k in keys if sim(c, k) >= least}
        found = linking.match_columns_by_name(
            spark.createDataFrame([(n,) for n in names], "col string"), spark.createDataFrame([(k,) for k in set(keys)], "keyword string"),
            least
        )
        assert {(r.col, r.keyword) for r in found.collect()} == want
    sims = spark.createDataFrame([("Name", 0.2), ("names", 0.8)], "col string, sim double")
    found = linking.match_columns_by_name(
        spark.createDataFrame([("Name",), ("names",), ("nam",)], "col string"), spark.createDataFrame([("name",)], "keyword string"), 0.8,
        sims
    )
    assert [r.col for r in found.collect()] == ["names", "Name", "nam"]


def test_mentions_with_bounds_equal_all_windows(spark):
    draw = random.Random(3)
    qs = [(i, " ".join("".join(draw.choices("abc", k=draw.randint(1, 5))) for _ in range(draw.randint(1, 9)))) for i in range(30)]
    ls = [(i, "".join(draw.choices("abc ", k=draw.randint(1, 9)))) for i in range(30) for _ in range(2)]
    found = linking.mention_sim(
        spark.createDataFrame(qs, "question_id int, question string"), spark.createDataFrame(ls, "question_id int, literal string")
    )
    want = set()
    for i, q in qs:
        ws = q.split()
        windows = {" ".join(ws[a : a + n]) for n in range(1, 5) for a in range(max(1, len(ws) - n + 1))}
        for j, literal in ls:
            if i == j:
                s, w = max((SequenceMatcher(None, w, literal).ratio(), w) for w in windows)
                want.add((i, literal, round(s, 9), w))
    assert {(r.question_id, r.literal, round(r.sim, 9), r.window) for r in found.collect()} == want


def test_banded_minhash_recall(spark):
    """Recall of the ten nearest against the exact way, on names with many similar ones."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(4, 9))) for _ in range(40)]
    names = sorted({" ".join(draw.choices(words, k=3)) for _ in range(300)})
    values = spark.createDataFrame([(n, "x") for n in [*names, "", None, "ab"]], "value string, keyword string")
    keys = values.select(F.col("value").alias("keyword"))
    exact = minhash.exact_similar_values(values, keys).cache()
    best = {(r.keyword, r.value): r.jaccard for r in exact.collect()}
    worst = {k: min(j for (k2, _), j in best.items() if k2 == k) for k, _ in best}
    found = minhash.similar_values(values, keys, exact=True).collect()
    right = sum(r.jaccard >= worst[r.keyword] - 1e-12 for r in found)
    assert right / len(best) >= 0.9
    assert {(r.keyword, r.value) for r in found if r["rank"] == 1} == {(r.keyword, r.value) for r in exact.collect() if r["rank"] == 1}
    for est in (minhash.similar_values(values, keys), minhash.similar_values(values, keys, rows=2)):
        assert all(abs(r.jaccard - best[r.keyword, r.value]) < 0.25 for r in est.collect() if (r.keyword, r.value) in best)


def test_vectors_that_take_no_part(spark):
    q = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, []), (5, [1.0])]
    items = [(10, [2.0, 0.0]), (11, None), (12, [1.0, None]), (13, [1.0]), (14, [0.0, 1.0]), (15, [])]
    queries = spark.createDataFrame(q, "query_id int, v array<double>")
    base = spark.createDataFrame(items, "item_id int, v array<double>")
    assert rows(linking.vector_topk(queries, base, 3).select("query_id", "item_id", "rank")) == [(1, 10, 1), (1, 14, 2)]
    assert linking.vector_topk(queries.where("query_id = 2"), base, 3).count() == 0
    assert linking.vector_topk(queries, base.where("item_id = 11"), 3).count() == 0

"""Search for schema elements, values and documents."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from graphloom.functions.terms import RDF_TYPE
from graphloom.operators.edits import candidates
from graphloom.operators.minhash import similar_values
from graphloom.operators.patterns import bgp
from graphloom.operators.schema import closure
from graphloom.operators.substrings import SubstringIndex, build_index, search
from graphloom.sizes import cut, parts, shared_folder

#: Numbers of query vectors that a task holds, and items that pass it, at least and at most.
QUERY_FLOATS, BATCH, TASK_ITEMS = 4_000_000, 10_000, 1 << 20
#: Scores that a task holds at once.
SCORES = 1 << 19
#: Tasks that count the subjects of one text, at most.
TEXT_SALTS = 64


def grep(elements: DataFrame, term: str, kind: str | None = None) -> DataFrame:
    """L1: elements (element_id, type, text, ...) that contain the term, any case, once each."""
    found = elements.where(F.contains(F.lower("text"), F.lit(term.lower())))
    return (found.where(F.col("type") == kind) if kind else found).dropDuplicates(["element_id"])


def grep_terms(elements: DataFrame, terms: DataFrame, index: SubstringIndex, kind: str | None = None) -> DataFrame:
    """L1 for many terms (term) at once: (term, element columns), each element of a term once; ``index`` is of the elements' texts."""
    own = elements.where(F.col("type") == kind) if kind else elements
    return search(index, terms).join(own, "text").dropDuplicates(["term", "element_id"]).select("term", *elements.columns)


def with_hierarchy(found: DataFrame, edges: DataFrame) -> DataFrame:
    """L1: found classes (element_id) with parent_classes, ancestor_chain (nearest first, then by name), child_classes and hierarchy_depth.

    edges are (child, parent); the depth is the number of ancestors. A class without edges has empty lists.
    """
    up = closure(edges)
    own = found.select("element_id").distinct()
    none = F.array().cast("array<string>")
    names = lambda c: F.sort_array(F.collect_set(c))
    parents = own.join(edges, F.col("element_id") == F.col("child")).groupBy("element_id").agg(names("parent").alias("parent_classes"))
    children = own.join(edges, F.col("element_id") == F.col("parent")).groupBy("element_id").agg(names("child").alias("child_classes"))
    chain = F.transform(F.sort_array(F.collect_set(F.struct("depth", "ancestor"))), lambda x: x["ancestor"])
    above = own.join(up, F.col("element_id") == F.col("child")).groupBy("element_id").agg(chain.alias("ancestor_chain"))
    out = found
    for t, c in ((parents, "parent_classes"), (above, "ancestor_chain"), (children, "child_classes")):
        out = out.join(t, "element_id", "left").withColumn(c, F.coalesce(c, none))
    return out.withColumn("hierarchy_depth", F.size("ancestor_chain"))


def vector_topk(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """L3: (query_id, item_id, score, rank), the k items of largest cosine for each query (query_id, v) over items (item_id, v).

    Queries and items meet in blocks: a task holds queries of at most QUERY_FLOATS numbers and k items for each, and
    its share of the items passes by. Nothing is gathered on the driver. Ties, of cosines rounded to 12 digits, go to the
    smaller item. Vectors that are null, hold a null or have another length than the longest query take no part; without
    queries there are no rows.
    """
    spark = items.sparkSession
    whole = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    queries = queries.where(whole)
    dim = queries.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    queries, items = queries.where(F.size("v") == dim), items.where(whole & (F.size("v") == dim))
    n_queries, n_items = max(1, queries.count()), items.count()
    blocks = max(1, -(-n_queries * max(1, dim) // QUERY_FLOATS))
    salts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks, -(-n_items // BATCH)), -(-n_items // TASK_ITEMS), 1)
    kinds = queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select(
        F.lit(0).alias("kind"), "query_id", F.lit(None).cast(kinds[1]).alias("item_id"), "v", place("query_id", blocks).alias("block"),
        number(salts).alias("salt")
    )
    passed = items.select(
        F.lit(1).alias("kind"), F.lit(None).cast(kinds[0]).alias("query_id"), "item_id", "v", number(blocks).alias("block"),
        place("item_id", salts).alias("salt")
    )
    met = asked.unionByName(passed).withColumn("task", F.col("block") * salts + F.col("salt"))
    met = met.repartitionById(blocks * salts, "task").sortWithinPartitions("task", "kind").select(
        "task", "kind", "query_id", "item_id", "v"
    )

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        x = np.stack([np.asarray(v, np.float64) for v in frame["v"]])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, q = None, [], None
        for frame in frames:
            for task, own in frame.groupby("task", sort=False):
                if task != now:
                    now, held, q = task, [], None
                if len(asking := own[own["kind"] == 0]):
                    held.append(asking)
                own = own[own["kind"] == 1].sort_values("item_id", kind="stable", na_position="first")
                if not len(own) or (q is None and not held):
                    continue
                if q is None:
                    ids, q, held = np.concatenate([h["query_id"].to_numpy() for h in held]), np.concatenate([matrix(h) for h in held]), held[:0]
                x, items_here = matrix(own), own["item_id"].to_numpy()
                step = max(1, SCORES // len(own))
                for a in range(0, len(ids), step):
                    score = q[a : a + step] @ x.T
                    keys = np.round(score, 12) + 0.0
                    keep = np.argsort(-keys, axis=1, kind="stable")[:, :k]
                    at = np.repeat(np.arange(len(keep)), keep.shape[1])
                    yield pd.DataFrame(
                        {"query_id": ids[a : a + step][at], "item_id": items_here[keep.ravel()], "score": score[at, keep.ravel()], "key": keys[at, keep.ravel()]}
                    )

    out = met.mapInPandas(best, f"query_id {kinds[0]}, item_id {kinds[1]}, score double, key double")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "item_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("key")


def vector_topk_typed(queries: DataFrame, items: DataFrame, types: DataFrame, kind, k: int) -> DataFrame:
    """L4: the k best of one type among the overall 3k best; ``types`` is (item_id, type)."""
    near = vector_topk(queries, items, 3 * k).join(types.where(F.col("type") == kind), "item_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("type_rank", F.row_number().over(order)).where(F.col("type_rank") <= k)


def property_values(g: DataFrame, cls: str, prop: str, n: int) -> DataFrame:
    """The first n distinct values of a class's property."""
    return _values(g, cls, prop).distinct().orderBy("value").limit(n)


def _values(g: DataFrame, cls: str, prop: str) -> DataFrame:
    return bgp(g, [("?x", RDF_TYPE, cls), ("?x", prop, "?value")]).select("value")


def grep_values(g: DataFrame, cls: str, prop: str, pattern: str, n: int = 500) -> DataFrame:
    """The first n of a class's distinct values of a property that match the pattern, in any case."""
    return _values(g, cls, prop).where(F.col("value").rlike(f"(?i){pattern}")).distinct().orderBy("value").limit(n)


def grep_values_terms(g: DataFrame, cls: str, prop: str, terms: DataFrame, index: SubstringIndex, n: int = 500) -> DataFrame:
    """L6 for many literal terms (term): (term, value), the first n values of each; ``index`` is of the graph's literals."""
    met = search(index, terms).withColumnRenamed("text", "value").join(_values(g, cls, prop).distinct(), "value")
    order = Window.partitionBy("term").orderBy("value")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("term", "value")


def search_values(values: DataFrame, query: DataFrame, k: int = 50, most: int = 500) -> DataFrame:
    """The k nearest of at most ``most`` distinct non-blank values (value, v)."""
    own = values.where(F.trim("value") != "").groupBy("value").agg(F.min("v").alias("v")).orderBy("value").limit(most)
    return vector_topk(query, own.withColumnRenamed("value", "item_id"), min(k, 50))


def profile_property(g: DataFrame, prop: str, n: int = 5) -> DataFrame:
    """Sample values, datatypes, and the numeric range of a property."""
    facts = g.where(F.col("p") == prop)
    number = F.col("o").try_cast("double")
    samples = facts.select("o").distinct().orderBy("o").limit(n).agg(F.array_sort(F.collect_list("o")).alias("samples"))
    stats = facts.agg(
        F.array_sort(F.collect_set("o_datatype")).alias("datatypes"), F.min(number).alias("low"), F.max(number).alias("high"),
        (F.max(number) - F.min(number)).alias("spread")
    )
    return stats.join(F.broadcast(samples))


def matches_as_triples(df: DataFrame) -> DataFrame:
    """Matches (instance, property, value) as triples."""
    return df.select(F.struct(F.col("instance").alias("s"), F.col("property").alias("p"), F.col("value").alias("o")).alias("triple"))


def rank_documents(hits: DataFrame, k: int, min_hits: int, n: int, margin: float) -> DataFrame:
    """Hits (query_id, doc, hit_id, distance): the k nearest, of documents with enough of them, whose mean of the best n is within the margin of the best document."""
    near = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "hit_id"))).where(F.col("r") <= k)
    near = near.withColumn("in_doc", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("distance", "hit_id")))
    docs = near.groupBy("query_id", "doc").agg(
        F.count(F.lit(1)).alias("n_hits"), F.avg(F.when(F.col("in_doc") <= n, F.col("distance"))).alias("doc_score")
    )
    docs = docs.where(F.col("n_hits") >= min_hits)
    best = docs.groupBy("query_id").agg(F.min("doc_score").alias("best"))
    kept = docs.join(best, "query_id").where(F.col("doc_score") <= F.col("best") * (1 + margin))
    return near.join(
        kept.select("query_id", "doc", "doc_score"), ["query_id", "doc"]
    ).select("query_id", "doc", "hit_id", "distance", "doc_score")


def token_budget(docs: DataFrame, budget: int) -> DataFrame:
    """Docs (query_id, doc, score, size) by score until the first that doesn't fit, with what is ``used``; unknown sizes are free before it.

    Sizes aren't negative. A query's documents are summed in ranges, whose totals are then added up, so one with very many isn't one task's work.
    """
    size = F.coalesce("size", F.lit(0))
    placed = cut(docs.repartitionByRange("query_id", F.desc("score"), "doc").withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("query_id", "_range").orderBy(F.desc("score"), "doc").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("query_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("query_id", "_range").agg(F.sum(size).alias("_total"))
    totals = totals.select(
        F.col("query_id").alias("_query"), F.col("_range").alias("_at"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    summed = placed.withColumn("used", F.sum(size).over(within)).join(
        totals, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("_range") == F.col("_at"))
    )
    return summed.withColumn("used", F.col("used") + F.col("_before")).where(F.col("used") <= budget).select(*docs.columns, "used")


def target_rank(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores (phrase, element, type, domain, score), targets (phrase, element, domain): rank within type and overall; the expected domain first, else the best."""
    by_type = Window.partitionBy("phrase", "type").orderBy(F.desc("score"), "element", "domain")
    overall = Window.partitionBy("phrase").orderBy(F.desc("score"), "element", "domain")
    ranked = scores.withColumn("type_rank", F.row_number().over(by_type)).withColumn("rank", F.row_number().over(overall))
    met = ranked.join(targets.withColumnRenamed("domain", "expected"), ["phrase", "element"])
    miss = F.when(F.col("domain") == F.col("expected"), 0).otherwise(1)
    best = met.groupBy("phrase", "element").agg(F.min(F.struct(miss.alias("miss"), "rank", "type_rank")).alias("b"))
    return best.select("phrase", "element", "b.rank", "b.type_rank")


def reachability(ranks: DataFrame, k: int) -> DataFrame:
    """Per phrase whether all targets are among the k of their type and 3k overall, and the worst rank."""
    return ranks.groupBy("phrase").agg(
        F.bool_and((F.col("type_rank") <= k) & (F.col("rank") <= 3 * k)).alias("reachable"), F.max("rank").alias("worst_rank")
    )


def _forms(x: Column) -> Column:
    """A normalised phrase and what its singular may be."""
    n = F.length(x)
    cut = lambda k: F.substring(x, F.lit(1), n - k)
    return F.array_compact(
        F.array(
            x, F.when(x.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y"))), F.when(x.endswith("es") & (n > 4), cut(2)),
            F.when(x.endswith("s") & (n > 3), cut(1))
        )
    )


def phrase_score(phrase: Column, name: Column) -> Column:
    """How well a phrase names an element: 2 if they agree but for a plural, 1 if the name (six letters) stands in the phrase or the phrase's stem (five) in the name, else 0."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (phrase, name))
    n = F.length(x)
    stem = x
    for end in ("s", "es", "ed", "ing"):
        stem = F.when(x.endswith(end) & (n > len(end) + 3), F.substring(x, F.lit(1), n - len(end))).otherwise(stem)
    held = (F.length(y) >= 6) & F.contains(x, y)
    return F.when(F.arrays_overlap(_forms(x), _forms(y)), 2).when(held | ((F.length(stem) >= 5) & F.contains(y, stem)), 1).otherwise(0)


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _best_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each row's windows the most similar to ``low``, the last one of several; those whose shared letters can't reach the best so far are not compared."""
    for frame in frames:
        found = []
        for windows, low in zip(frame["windows"], frame["low"], strict=True):
            held, best, sims = Counter(low), 0.0, []
            bounds = sorted(((2 * sum((Counter(w) & held).values()) / max(1, len(w) + len(low)), w) for w in windows), reverse=True)
            for bound, w in bounds:
                if bound < best - 1e-9:
                    break
                sims.append((SequenceMatcher(None, w, low).ratio(), w))
                best = max(best, sims[-1][0])
            found.append(max(sims))
        yield frame[["question_id", "literal"]].assign(sim=[x for x, _ in found], window=[w for _, w in found])


def mention_sim(questions: DataFrame, literals: DataFrame) -> DataFrame:
    """For (question_id, question) and (question_id, literal): the most similar window of 1 to 4 words.

    A question's windows stay one row, never shuffled; only its best one of each literal is.
    """
    words = F.split(F.lower(F.trim("question")), r"\s+")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(4)),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " ")
            )
        )
    )
    met = questions.join(literals, "question_id").where("question is not null and literal is not null")
    rows = met.select("question_id", "literal", F.lower("literal").alias("low"), F.array_distinct(spans).alias("windows"))
    kind = rows.schema["question_id"].dataType.simpleString()
    found = rows.mapInPandas(_best_windows, f"question_id {kind}, literal string, sim double, window string")
    best = found.groupBy("question_id", "literal").agg(F.max(F.struct("sim", "window")).alias("b"))
    return best.select(
        "question_id", "literal", "b.sim", "b.window",
        (F.substring("b.window", 1, 3) == F.substring(F.lower("literal"), 1, 3)).alias("same_prefix")
    )


#: Parts of column names that are not worth an index (fixed values); names that end with Id aren't either.
BLOCKED = ["_id", " id", "url", "email", "web", "time", "phone", "date", "address"]


def eligible_columns(
    df: DataFrame, keys: list[str], most: int = 100, total: int = 2_000_000, mean: float = 25.0, total_names: int = 5_000_000
) -> DataFrame:
    """Text columns and whether they are worth an index: by name, and by lengths and number of distinct values.

    A column is if its distinct values are together below ``total_names`` characters and its name has "name" in it, or below
    ``total`` and on average below ``mean``, or fewer than ``most``. Keys are left out.
    """
    texts = [c for c, t in df.dtypes if t == "string" and c.lower() not in {k.lower() for k in keys}]
    if not texts:
        return df.sparkSession.createDataFrame([], "col string, n_values long, sum_length long, mean_length double, eligible boolean")
    cells = df.select(*texts).unpivot([], texts, "col", "value").where("value is not null").distinct()
    stats = cells.groupBy("col").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum(F.length("value")).alias("sum_length"), F.avg(F.length("value")).alias("mean_length")
    )
    name = F.lower("col")
    blocked = F.col("col").endswith("Id")
    for part in BLOCKED:
        blocked = blocked | F.contains(name, F.lit(part))
    named = F.contains(name, F.lit("name")) & (F.col("sum_length") < total_names)
    fits = ~blocked & (named | ((F.col("sum_length") < total) & (F.col("mean_length") < mean)) | (F.col("n_values") < most))
    return stats.withColumn("eligible", fits)


def lsh_values(values: DataFrame, keywords: DataFrame, n: int = 10, hashes: int = 100, rows: int = 1, exact: bool = True) -> DataFrame:
    """For each keyword the n values of largest Jaccard on 3-grams of characters, met by MinHash bands.

    What meets is compared by its 3-grams, or estimated from signatures alone if not ``exact``.
    """
    return similar_values(values, keywords, n, hashes, rows, exact)


def keyword_parts(df: DataFrame) -> DataFrame:
    """(id, keyword) -> the whole, both sides of every blank, and what follows an equals sign."""
    w = F.split("keyword", " ")
    sides = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)),
            lambda i: F.array(F.array_join(F.slice(w, F.lit(1), i), " "), F.array_join(F.slice(w, i + 1, F.size(w)), " "))
        )
    )
    after = F.when(
        F.contains("keyword", F.lit("=")), F.array(F.trim(F.element_at(F.split("keyword", "="), -1)))
    ).otherwise(F.array().cast("array<string>"))
    return df.select("id", F.explode(F.array_distinct(F.concat(F.array("keyword"), sides, after))).alias("part")).where("part <> ''")


def filter_entities(cands: DataFrame) -> DataFrame:
    """Candidates (keyword, col, value, sim) with ratio >= 0.3 and vector similarity >= 0.6, then within 0.9 of the column's best of each."""
    scored = cands.withColumn("ratio", ratio(F.lower("keyword"), F.lower("value"))).where("ratio >= 0.3 and sim >= 0.6")
    by_col = Window.partitionBy("keyword", "col")
    near = scored.withColumn("r", F.max("ratio").over(by_col)).withColumn("s", F.max("sim").over(by_col))
    return near.where("ratio >= 0.9 * r and sim >= 0.9 * s").drop("r", "s")


def _letters_shared(a: str, b: str) -> Column:
    """How many letters the texts share, in any order: at least as many as a matcher of blocks finds."""
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), x, F.lit("")))
    return F.aggregate(
        F.array_distinct(F.split(F.col(a), "")), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.least(count(a, x), count(b, x)))
    )


def match_columns_by_name(cols: DataFrame, keywords: DataFrame, least: float = 0.9, sims: DataFrame | None = None) -> DataFrame:
    """Columns (col) and (keyword) whose names agree but for blanks, underscores and final s, or have a ratio of ``least``.

    With ``sims`` (col, sim), the columns' likeness to the question, rows are ordered by it, then by ratio. A ratio r of names
    of lengths m and n leaves at most (1 - r) * (m + n) letters unmatched, which bounds both their edits and n by m: pairs meet
    by segments for so many edits, and by letters that they share, before Python sees them.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "[ _]", "")), "s+$", "")
    a = cols.withColumn("_x", plain("col"))
    b = keywords.withColumn("_y", plain("keyword"))
    # 2 * min(m, n) >= least * (m + n), so m + n <= 2 / least * n and n <= (2 - least) / least * m; a little more for rounding
    edits = lambda n: F.floor(n * ((1 - least) * 2 / least + 1e-9))
    longest = lambda n: F.floor(n * ((2 - least) / least + 1e-9))
    met = candidates(a, b, "_x", "_y", edits, longest)
    total = F.length("_x") + F.length("_y")
    near = met.where((2 * _letters_shared("_x", "_y") >= total * (least - 1e-9)))
    found = near.withColumn("ratio", ratio("_x", "_y")).where(F.col("ratio") >= least).drop("_x", "_y")
    if sims is None:
        return found.orderBy(F.desc("ratio"), "col")
    return found.join(sims, "col", "left").orderBy(F.desc_nulls_last("sim"), F.desc("ratio"), "col")


def describe(near: DataFrame) -> DataFrame:
    """Near (query_id, tbl, col, text, rank): the first hit of each column."""
    order = Window.partitionBy("query_id", "tbl", "col").orderBy("rank")
    return near.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def search_instances(g: DataFrame, terms: DataFrame, index: SubstringIndex | None = None) -> DataFrame:
    """For each dataset and term (term) of at least three letters how many literals of ``g`` contain it, and the first subject.

    ``index`` is of the graph's literals; without one it is built in the shared folder.
    """
    own = g.where("o_kind = 'literal'")
    index = index or build_index(own, f"{shared_folder(g.sparkSession)}/literals-{uuid.uuid4().hex}", "o")
    n = parts(own.count())
    # the literals of a text are counted before terms meet it, those of a very common one in several tasks
    salted = own.select("dataset", F.col("o").alias("text"), "s", F.pmod(F.xxhash64("s"), F.lit(TEXT_SALTS)).alias("salt"))
    some = salted.repartition(n, "text", "salt").groupBy("dataset", "text", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("example"))
    total = F.sum("n").alias("n"), F.min("example").alias("example")
    counted = some.repartition(n, "text").groupBy("dataset", "text").agg(*total)
    texts = index.texts.hint("merge").join(counted, "text")
    return search(replace(index, texts=texts), terms.where(F.length("term") >= 3)).groupBy("dataset", "term").agg(*total)

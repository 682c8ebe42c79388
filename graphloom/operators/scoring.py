"""Comparison of results with accepted answers, for many (run, reading) pairs in one job.

Cells are (pair, row_id, col, value); tuples are (pair, row) with row array<string>. The
pair is a grouping key everywhere, so nothing loops over runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _prf(tp: Column, n_actual: Column, n_expected: Column) -> list[Column]:
    p = F.when(n_actual > 0, tp / n_actual).otherwise(F.lit(0.0))
    r = F.when(n_expected > 0, tp / n_expected).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1")]


def _multiset(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    count = lambda df, n: df.groupBy("pair", key).agg(F.count(F.lit(1)).alias(n))
    both = count(actual, "a").join(count(expected, "e"), ["pair", key], "full").na.fill(0, ["a", "e"])
    return both.groupBy("pair").agg(F.sum(F.least("a", "e")).alias("tp"), F.sum("a").alias("n_a"), F.sum("e").alias("n_e"))


def score_values(actual: DataFrame, expected: DataFrame, pairs: DataFrame) -> DataFrame:
    """Multiset of values, names ignored. Both empty: 1; expected empty and output present: recall 1."""
    t = pairs.select("pair").distinct().join(_multiset(actual, expected, "value"), "pair", "left").na.fill(0)
    empty, none = (F.col("n_a") == 0) & (F.col("n_e") == 0), F.col("n_e") == 0
    p, r, f = _prf(F.col("tp"), F.col("n_a"), F.col("n_e"))
    one = F.lit(1.0)
    return t.select(
        "pair", F.when(empty, one).otherwise(p).alias("precision"), F.when(none, one).otherwise(r).alias("recall"),
        F.when(empty, one).otherwise(f).alias("f1"), ((F.col("tp") == F.col("n_a")) & (F.col("tp") == F.col("n_e"))).alias("exact")
    )


def score_rows(actual: DataFrame, expected: DataFrame, pairs: DataFrame) -> DataFrame:
    """Multiset of rows, a row being the set of its values; rounded to 4. Both empty: 1."""
    rows = lambda df: df.groupBy("pair", "row_id").agg(F.array_sort(F.collect_set("value")).alias("row"))
    t = pairs.select("pair").distinct().join(_multiset(rows(actual), rows(expected), "row"), "pair", "left").na.fill(0)
    empty = (F.col("n_a") == 0) & (F.col("n_e") == 0)
    return t.select(
        "pair",
        *(F.round(F.when(empty, F.lit(1.0)).otherwise(c), 4).alias(n) for c, n in zip(_prf(F.col("tp"), F.col("n_a"), F.col("n_e")), ("precision", "recall", "f1"), strict=True))
    )


def score_cells(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Each actual row, in order, takes the free expected row with most equal cells, the smaller one of several; one pair a group.

    Expected rows of equal cells are one class with a queue, so a row is compared with the classes that share a cell, not with rows,
    and pairs of rows are never made.
    """

    def greedy(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        pair = (a if len(a) else e)["pair"].iloc[0]
        a, e = (f[f["col"].notna() & f["value"].notna() & f["row_id"].notna()] for f in (a, e))
        code = pd.concat([a[["col", "value"]], e[["col", "value"]]]).groupby(["col", "value"], sort=False).ngroup().to_numpy()
        queues, contents, postings = [], {}, {}
        for rank, cells in enumerate(_cells_by_row(e, code[len(a) :])):
            own = contents.setdefault(cells.tobytes(), len(contents))
            if own == len(queues):
                queues.append([])
                for cell, n in zip(*np.unique(cells, return_counts=True), strict=True):
                    postings.setdefault(cell, ([], []))
                    postings[cell][0].append(own)
                    postings[cell][1].append(n)
            queues[own].append(rank)
        postings = {c: (np.array(k), np.array(n)) for c, (k, n) in postings.items()}
        gone = len(e) + 1
        head, at, total, weight = np.array([q[0] for q in queues] or [gone]), [0] * len(queues), 0, np.zeros(len(queues) + 1, np.int64)
        for cells in _cells_by_row(a, code[: len(a)]) if queues else ():
            met = [postings[c] for c in cells if c in postings]
            if not met:
                continue
            for k, n in met:
                weight[k] += n
            k = np.concatenate([k for k, _ in met])
            # most equal cells first, then the smallest row; a class without free rows is worth nothing
            worth = np.where(head[k] < gone, weight[k] * (gone + 1) - head[k], 0)
            best = k[np.argmax(worth)]
            if worth.max() > 0:
                total += int(weight[best])
                at[best] += 1
                head[best] = queues[best][at[best]] if at[best] < len(queues[best]) else gone
            weight[k] = 0
        return pd.DataFrame({"pair": [pair], "tp": [total]})

    kind = actual.schema["pair"].dataType.simpleString()
    cells = lambda df: df.select("pair", "row_id", "col", "value").groupBy("pair")
    tp = cells(actual).cogroup(cells(expected)).applyInPandas(greedy, f"pair {kind}, tp long")
    sizes = actual.groupBy("pair").agg(F.count(F.lit(1)).alias("n_a")).join(
        expected.groupBy("pair").agg(F.count(F.lit(1)).alias("n_e")), "pair", "full"
    )
    t = sizes.join(tp, "pair", "left").na.fill(0)
    return t.select("pair", *_prf(F.col("tp"), F.col("n_a"), F.col("n_e")))


def _cells_by_row(frame: pd.DataFrame, code: np.ndarray) -> list[np.ndarray]:
    """The sorted cell numbers of each row, in order of the rows."""
    rank = pd.factorize(frame["row_id"], sort=True)[0]
    order = np.lexsort((code, rank))
    return np.split(code[order], np.flatnonzero(np.diff(rank[order])) + 1) if len(order) else []


def score_tuples(gt: DataFrame, sys: DataFrame) -> DataFrame:
    """Sets of tuples; nothing on both sides scores 0."""
    both = gt.select("pair", "row", F.lit(1).alias("g")).distinct().join(
        sys.select("pair", "row", F.lit(1).alias("s")).distinct(), ["pair", "row"], "full"
    ).na.fill(0, ["g", "s"])
    t = both.groupBy("pair").agg(
        F.sum(F.col("g") * F.col("s")).alias("tp"), F.sum(F.col("s") * (1 - F.col("g"))).alias("fp"),
        F.sum(F.col("g") * (1 - F.col("s"))).alias("fn")
    )
    return t.select("pair", "tp", "fp", "fn", *_prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def score_topn(gt: DataFrame, sys: DataFrame, descending: bool = True) -> DataFrame:
    """E5: rows (pair, row, score): those beyond the boundary score count exactly; any row at it fills a tied slot.

    Expected rows without a score are ignored; found ones without are wrong. Of pairs in which no expected row has a score, rows
    are compared exactly.
    """
    g = gt.where("score is not null").select("pair", "row", "score").distinct()
    edge = g.groupBy("pair").agg((F.min if descending else F.max)("score").alias("edge"))
    plain = score_tuples(
        gt.join(edge, "pair", "left_anti"), sys.join(gt.select("pair").distinct(), "pair", "left_semi").join(edge, "pair", "left_anti")
    )
    g = g.join(edge, "pair").withColumn("tied", F.col("score") == F.col("edge"))
    slots = g.groupBy("pair").agg(F.count_if("tied").alias("slots"), F.count_if(~F.col("tied")).alias("strict"))
    s = sys.select("pair", "row", "score").distinct().join(edge, "pair").join(
        g.where(~F.col("tied")).select("pair", "row", F.lit(True).alias("hit")), ["pair", "row"], "left"
    )
    counts = s.groupBy("pair").agg(
        F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"),
        F.count_if((F.col("score") == F.col("edge")) & F.col("hit").isNull()).alias("at_edge"), F.count(F.lit(1)).alias("n")
    )
    t = slots.join(counts, "pair", "left").na.fill(0).withColumn("tp", F.col("hits") + F.least("at_edge", "slots"))
    tied = t.select("pair", "tp", *_prf(F.col("tp"), F.col("n"), F.col("slots") + F.col("strict")))
    return tied.unionByName(plain.select(*tied.columns))


def score_prefix(gt: DataFrame, sys: DataFrame) -> DataFrame:
    """Gt (pair, pos, row) in order from 1: how many of its first rows are found without a gap, and whether they are all that was found (not if none are)."""
    seen = gt.join(sys.select("pair", "row", F.lit(1).alias("s")).distinct(), ["pair", "row"], "left")
    first = seen.groupBy("pair").agg(F.min(F.when(F.col("s").isNull(), F.col("pos"))).alias("gap"), F.count(F.lit(1)).alias("n"))
    first = first.withColumn("prefix", F.coalesce(F.col("gap") - 1, F.col("n")))
    # those beyond a gap are found, but not in the prefix
    own = seen.join(first.select("pair", "prefix"), "pair").where("pos <= prefix").groupBy("pair").agg(F.count_distinct("row").alias("own"))
    size = sys.groupBy("pair").agg(F.count_distinct("row").alias("m"))
    t = first.join(own, "pair", "left").join(size, "pair", "left").na.fill(0, ["own", "m"])
    return t.select("pair", "prefix", "n", ((F.col("prefix") > 0) & (F.col("m") == F.col("own"))).alias("perfect"))


def column_values(cells: DataFrame) -> DataFrame:
    """Distinct values of each column."""
    return cells.select("pair", "col", "value").distinct()


def active_levels(gt: DataFrame, sys: DataFrame) -> DataFrame:
    """Gt (pair, level, value): overlaps by level; acceptable counts only if preferred does."""
    hits = gt.distinct().join(
        sys.select("pair", "value").distinct(), ["pair", "value"], "left_semi"
    ).groupBy("pair", "level").agg(F.count(F.lit(1)).alias("n"))
    preferred = hits.where("level = 'preferred' and n > 0").select("pair")
    return hits.where("level <> 'acceptable'").unionByName(hits.where("level = 'acceptable'").join(preferred, "pair", "left_semi"))


def column_overlap(
    gt: DataFrame, sys: DataFrame, gt_properties: DataFrame | None = None, sys_properties: DataFrame | None = None
) -> DataFrame:
    """Shared non-trivial values of each (gt column, system column).

    If what is shared is numeric or temporal, columns whose properties (pair, col, properties array) are known
    on both sides must have one in common.
    """
    from graphloom.functions.text import infer_kind, is_trivial

    use = lambda df, c: df.where(~is_trivial(F.col("value"))).select("pair", F.col("col").alias(c), "value").distinct()
    shared = use(gt, "gt_col").join(use(sys, "sys_col"), ["pair", "value"])
    out = shared.groupBy("pair", "gt_col", "sys_col").agg(F.count(F.lit(1)).alias("overlap"))
    if gt_properties is None or sys_properties is None:
        return out
    keys = ["pair", "gt_col", "sys_col"]
    kinds = infer_kind(shared.select(F.struct(*keys).alias("col"), "value")).where("kind <> 'none'").select("col.*")
    known = lambda df, c: df.where(F.size("properties") > 0).select(
        "pair", F.col("col").alias(c), F.col("properties").alias(f"{c}_p")
    )
    blocked = kinds.join(known(gt_properties, "gt_col"), ["pair", "gt_col"]).join(
        known(sys_properties, "sys_col"), ["pair", "sys_col"]
    ).where(~F.arrays_overlap("gt_col_p", "sys_col_p"))
    return out.join(blocked.select(*keys), keys, "left_anti")


def pair_columns(overlap: DataFrame) -> DataFrame:
    """Greedy one-to-one pairing, largest overlap first, then column order; one pair a group (tens of rows)."""

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        for row in frame.sort_values(["overlap", "gt_col", "sys_col"], ascending=[False, True, True]).itertuples():
            if row.gt_col not in left and row.sys_col not in right:
                left.add(row.gt_col)
                right.add(row.sys_col)
                keep.append(row.Index)
        return frame.loc[keep]

    return overlap.groupBy("pair").applyInPandas(greedy, overlap.schema)


def drop_bind_labels(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Without the columns (pair, col) that only label a bound value."""
    return cells.join(columns, ["pair", "col"], "left_anti")


def null_variants(rows: DataFrame) -> DataFrame:
    """(pair, row) -> (pair, variant, row): for each set of columns that hold nulls ('' here), the rows complete in it.

    Bit i of a variant means that column i must not be null. All 2**n variants of n null columns are made,
    by twelve columns at a time.
    """
    mask = F.aggregate(
        F.sequence(F.lit(1), F.size("row")), F.lit(0).cast("long"), lambda a,
        i: a + F.when(F.element_at("row", i.cast("int")) == "", F.pow(F.lit(2.0), i - 1).cast("long")).otherwise(F.lit(0).cast("long"))
    )
    marked = rows.withColumn("mask", mask)
    variants = marked.groupBy("pair").agg(F.bit_or("mask").alias("nulls")).withColumn("variant", F.lit(0).cast("long"))
    for first in range(0, 63, 12):
        bits = F.filter(
            F.array(*(F.lit(1 << i).cast("long") for i in range(first, min(first + 12, 63)))), lambda b: b.bitwiseAND(F.col("nulls")) != 0
        )
        subsets = F.aggregate(bits, F.array(F.lit(0).cast("long")), lambda a, b: F.concat(a, F.transform(a, lambda x: x + b)))
        variants = variants.withColumn("subset", F.explode(subsets)).withColumn(
            "variant", F.col("variant") + F.col("subset")
        ).drop("subset")
    return marked.join(variants, "pair").where("mask & variant = 0").select("pair", "variant", "row")


def score_adaptive(gt_variants: DataFrame, sys: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The best variant of each pair by F1, recall, precision.

    Pairs in ``order`` (pair, place, descending) are ranked by the number at the 1-based ``place`` of their rows, so that ties at the
    boundary are tolerated (E5).
    """
    key = F.struct("pair", "variant")
    g = gt_variants.select(key.alias("pair"), "row")
    s = gt_variants.select("pair", "variant").distinct().join(sys, "pair").select(key.alias("pair"), "row")
    named = ["pair.pair", "pair.variant", "precision", "recall", "f1"]
    if order is None:
        scored = score_tuples(g, s).select(*named)
    else:
        own = order.select(F.col("pair").alias("_pair"), "place", "descending")
        number = F.element_at("row", F.col("place")).try_cast("double")
        ranked = lambda df: df.join(own, F.col("pair.pair") == F.col("_pair")).select(
            "pair", "row", F.when(F.col("descending"), number).otherwise(-number).alias("score")
        )
        others = lambda df: df.join(own, F.col("pair.pair") == F.col("_pair"), "left_anti")
        scored = score_tuples(others(g), others(s)).select(*named).unionByName(score_topn(ranked(g), ranked(s)).select(*named))
    best = Window.partitionBy("pair").orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "variant")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def score_schema(columns: DataFrame, paired: DataFrame, n_sys: DataFrame) -> DataFrame:
    """Columns (pair, col, level, concept), paired (pair, gt_col), n_sys (pair, n): recall over preferred concepts, precision over system columns."""
    hit = columns.join(
        paired.select("pair", F.col("gt_col").alias("col"), F.lit(1).alias("hit")).distinct(), ["pair", "col"], "left"
    ).na.fill(0, ["hit"])
    concepts = hit.where("level = 'preferred'").groupBy("pair", "concept").agg(F.max("hit").alias("hit")).groupBy("pair").agg(
        F.avg("hit").alias("recall")
    )
    matched = hit.groupBy("pair").agg(F.sum("hit").alias("matched"))
    t = matched.join(concepts, "pair", "left").join(n_sys, "pair", "left")
    return t.select(
        "pair", F.coalesce("recall", F.lit(1.0)).alias("schema_recall"),
        F.when(
            F.coalesce("n", F.lit(0)) > 0, F.least(F.col("matched") / F.col("n"), F.lit(1.0))
        ).otherwise(F.lit(1.0)).alias("schema_precision")
    )


def score_schema_overlap(columns: DataFrame, gt: DataFrame, sys: DataFrame) -> DataFrame:
    """The older rule, by values that are shared and not trivial, without pairing.

    columns (pair, col, level, concept), cells (pair, col, value). A preferred concept is met if any of its columns shares a
    value with any found column; a column without a concept is one of its own. Precision is the share of found columns that share a
    value with any expected one, 0 without found columns; recall is 1 without preferred ones.
    """
    from graphloom.functions.text import is_trivial

    use = lambda df, c: df.where(
        F.col("value").isNotNull() & ~is_trivial(F.col("value"))
    ).select("pair", F.col("col").alias(c), "value").distinct()
    expected, found = use(gt.join(columns.select("pair", "col").distinct(), ["pair", "col"], "left_semi"), "gt_col"), use(sys, "sys_col")
    values = found.select("pair", "value").distinct()
    hit = expected.join(values, ["pair", "value"], "left_semi").select(
        "pair", F.col("gt_col").alias("col"), F.lit(1).alias("hit")
    ).distinct()
    own = columns.where("level = 'preferred'").join(hit, ["pair", "col"], "left").na.fill(0, ["hit"])
    concept = F.when(
        F.coalesce("concept", F.lit("")) == "", F.struct(F.lit(True), F.col("col").cast("string"))
    ).otherwise(F.struct(F.lit(False), F.col("concept").cast("string")))
    recall = own.groupBy("pair", concept.alias("c")).agg(F.max("hit").alias("hit")).groupBy("pair").agg(F.avg("hit").alias("recall"))
    matched = found.join(
        expected.select("pair", "value").distinct(), ["pair", "value"], "left_semi"
    ).groupBy("pair").agg(F.count_distinct("sys_col").alias("matched"))
    n = sys.where("value is not null").groupBy("pair").agg(F.count_distinct("col").alias("n"))
    t = columns.select("pair").distinct().join(recall, "pair", "left").join(n, "pair", "left").join(matched, "pair", "left")
    return t.select(
        "pair", F.coalesce("recall", F.lit(1.0)).alias("schema_recall"),
        F.coalesce(F.col("matched") / F.col("n"), F.lit(0.0)).alias("schema_precision")
    )


def best_reading(scores: DataFrame) -> DataFrame:
    """By schema recall, data F1, schema precision, then the first reading."""
    order = Window.partitionBy("run_id").orderBy(F.desc("schema_recall"), F.desc("data_f1"), F.desc("schema_precision"), "reading_id")
    return scores.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def rows_of(cells: DataFrame, paired: DataFrame, side: str) -> DataFrame:
    """(pair, row_id, row): the values of paired columns in the order of the expected ones, '' for null."""
    own = cells.join(paired.select("pair", F.col(side).alias("col"), F.col("gt_col").alias("place")), ["pair", "col"])
    return own.groupBy("pair", "row_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("value", F.lit("")).alias("value")))).getField("value").alias("row")
    )


def evaluate(
    gt_cells: DataFrame, sys_cells: DataFrame, columns: DataFrame, gt_properties: DataFrame | None = None,
    sys_properties: DataFrame | None = None, ranked: DataFrame | None = None, order: DataFrame | None = None
) -> DataFrame:
    """Every run against every reading, and each run's best reading; nothing loops over runs.

    Cells (pair, row_id, col, value) with pair struct<run_id, reading_id> and null values kept; columns (pair, col, level,
    concept, is_label). Label columns go (E12); columns are paired by shared values, not across properties (E9-E11); expected rows
    with blanks give variants, of which the best counts (E13, E14); concepts and columns are scored (E15). Of
    ``ranked`` pairs (pair, row_id, pos) the found prefix is told (E6). Pairs in ``order`` (pair, col, descending) tolerate ties at
    the boundary of that expected column, if it is paired (E5). A run that has no value of a preferred column finds nothing of
    the reading, whatever acceptable ones it has (E8). The best reading comes from schema and data (E17).
    """
    labels = columns.where("is_label").select("pair", "col")
    gt, named = drop_bind_labels(gt_cells, labels), columns.where("not is_label")
    levels = gt.where("value is not null").join(named.select("pair", "col", "level"), ["pair", "col"]).select("pair", "level", "value")
    valid = active_levels(levels, sys_cells.where("value is not null")).where("level = 'preferred'").select("pair").distinct()
    met = column_overlap(gt.where("value is not null"), sys_cells.where("value is not null"), gt_properties, sys_properties)
    paired = pair_columns(met.join(valid, "pair", "left_semi"))
    expected, found = rows_of(gt, paired, "gt_col"), rows_of(sys_cells, paired, "sys_col")
    if order is not None:
        places = paired.withColumn(
            "place", F.row_number().over(Window.partitionBy("pair").orderBy("gt_col"))
        ).select("pair", F.col("gt_col").alias("col"), "place")
        order = order.join(places, ["pair", "col"]).select("pair", "place", "descending")
    # a found row of blanks only is no row
    found = found.where(F.exists("row", lambda v: v != ""))
    best = score_adaptive(null_variants(expected.select("pair", "row").distinct()), found.select("pair", "row").distinct(), order)
    n_sys = sys_cells.groupBy("pair").agg(F.count_distinct("col").alias("n"))
    t = score_schema(named, paired, n_sys).join(
        best.select("pair", "variant", "precision", "recall", F.col("f1").alias("data_f1")), "pair", "left"
    )
    t = t.na.fill(0.0, ["precision", "recall", "data_f1"]).na.fill(0, ["variant"])
    if ranked is not None:
        prefix = score_prefix(expected.join(ranked, ["pair", "row_id"]).select("pair", "pos", "row"), found.select("pair", "row"))
        t = t.join(prefix.select("pair", "prefix", "perfect"), "pair", "left")
    return best_reading(t.select("pair.run_id", "pair.reading_id", *(c for c in t.columns if c != "pair")))


def level_values(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """The distinct values of each reading's levels; columns (question_id, reading_id, col, level)."""
    met = cells.where("value is not null").join(
        columns.select("question_id", "reading_id", "col", "level").distinct(), ["question_id", "reading_id", "col"]
    )
    return met.groupBy("question_id", "reading_id", "level").agg(
        F.count_distinct("value").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def build_gt(cells: DataFrame) -> DataFrame:
    """Per reading the number of rows, columns with nulls, and whether it is the question's default (first with rows)."""
    t = cells.groupBy("question_id", "reading_id").agg(
        F.count_distinct("row_id").alias("n_rows"),
        F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("col")))).alias("null_columns")
    )
    return t.withColumn("is_default", F.row_number().over(Window.partitionBy("question_id").orderBy("reading_id")) == 1)


def signatures(patterns: DataFrame, projections: DataFrame) -> DataFrame:
    """A signature of each projected variable, from its query's patterns (query_id, s, p, o; variables start with ?).

    projections (query_id, variable, agg, inner array of the variables in the aggregate, nested kind of aggregate or null)
    -> types, out and in predicates, the inner variables' predicates in either place, and the subjects' own
    types (type:), out (out:) and in predicates (in:) where the variable is an object.
    """
    from graphloom.functions.terms import RDF_TYPE

    p = patterns.select("query_id", "s", "p", "o").where(~F.col("p").startswith("?"))
    typed, keys = F.col("p") == RDF_TYPE, ["query_id", "variable"]
    none = F.lit(None).cast("string")
    as_s = p.select(
        "query_id", F.col("s").alias("variable"), F.when(typed & ~F.col("o").startswith("?"), F.col("o")).alias("type"),
        F.when(~typed, F.col("p")).alias("out"), none.alias("inn")
    )
    as_o = p.select(
        "query_id", F.col("o").alias("variable"), none.alias("type"), none.alias("out"), F.when(~typed, F.col("p")).alias("inn")
    )
    uses = as_s.unionByName(as_o).where(F.col("variable").startswith("?"))
    gathered = lambda *c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*c))))))
    own = uses.groupBy(*keys).agg(
        gathered("type").alias("types"), gathered("out").alias("out_predicates"), gathered("inn").alias("in_predicates")
    )
    inner = projections.select(*keys, F.explode("inner").alias("v"), "nested").join(
        uses.withColumnRenamed("variable", "v"), ["query_id", "v"]
    )
    inner = inner.groupBy(*keys).agg(
        gathered("out", "inn", F.when(F.col("nested").isNotNull(), F.concat(F.lit("_nested_"), "nested"))).alias("inner_predicates")
    )
    subject = p.where(F.col("s").startswith("?") & F.col("o").startswith("?")).select("query_id", F.col("o").alias("variable"), F.col("s").alias("v")).distinct().join(
        as_s.withColumnRenamed("variable", "v").unionByName(as_o.withColumnRenamed("variable", "v")).withColumnRenamed("out", "outs"),
        ["query_id", "v"]
    )
    tagged = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}:"), c)) for c, n in (("type", "type"), ("outs", "out"), ("inn", "in"))]
    context = subject.groupBy(*keys).agg(gathered(*tagged).alias("subject_context"))
    t = projections.select(*keys, "agg").join(own, keys, "left").join(inner, keys, "left").join(context, keys, "left")
    sets = ["types", "out_predicates", "in_predicates", "inner_predicates", "subject_context"]
    return t.select(*keys, "agg", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in sets))


def jaccard(a: str, b: str) -> Column:
    """Of two arrays; nothing on both sides is 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def signature_sim(pairs: DataFrame) -> DataFrame:
    """Columns a_* and b_* of two signatures of E20: sim from 0 to 1.

    Of two aggregates of one kind (SUM and COUNT count as one) the inner predicates' Jaccard; an aggregate is never like
    a plain column. Else the best of in, out and, if both have types, type Jaccard. That of in predicates is scaled
    by 0.7 to 1 with the Jaccard of the subjects' contexts, by 0.85 if only one side has a context.
    """
    a, b = F.col("a_agg"), F.col("b_agg")
    same = (a == b) | (a.isin("SUM", "COUNT") & b.isin("SUM", "COUNT"))
    context = F.when(
        (F.size("a_subject_context") > 0) & (F.size("b_subject_context") > 0), 0.7 + 0.3 * jaccard("a_subject_context", "b_subject_context")
    )
    context = context.when((F.size("a_subject_context") > 0) | (F.size("b_subject_context") > 0), 0.85).otherwise(1.0)
    # without types on one side, their Jaccard is 0
    plain = F.greatest(
        jaccard("a_in_predicates", "b_in_predicates") * context, jaccard("a_out_predicates", "b_out_predicates"),
        jaccard("a_types", "b_types")
    )
    either = F.when(a.isNull() & b.isNull(), plain).when(
        F.coalesce(same, F.lit(False)), jaccard("a_inner_predicates", "b_inner_predicates")
    )
    return pairs.withColumn("sim", either.otherwise(F.lit(0.0)))


def match_signatures(gt: DataFrame, sys: DataFrame, least: float = 0.3) -> DataFrame:
    """Signatures (pair, variable, ...) paired greedily one to one by likeness of at least ``least``; empty ones take no part."""
    sets = ["types", "out_predicates", "in_predicates", "inner_predicates", "subject_context"]
    full = lambda df, c: df.where(
        F.col("agg").isNotNull() | (F.size("types") + F.size("out_predicates") + F.size("in_predicates") > 0)
    ).select("pair", *(F.col(x).alias(f"{c}_{x}") for x in ("variable", "agg", *sets)))
    both = signature_sim(full(gt, "a").join(full(sys, "b"), "pair")).where(F.col("sim") >= least)
    return pair_columns(
        both.select("pair", F.col("a_variable").alias("gt_col"), F.col("b_variable").alias("sys_col"), F.col("sim").alias("overlap"))
    ).withColumnRenamed("overlap", "sim")


def retrieval_truth(patterns: DataFrame) -> DataFrame:
    """Patterns (question_id, p, o, necessity): each class and property, required if any use requires it."""
    from graphloom.functions.terms import RDF_TYPE

    terms = patterns.select(
        "question_id", F.when(F.col("p") == RDF_TYPE, F.col("o")).otherwise(F.col("p")).alias("term"),
        F.when(F.col("p") == RDF_TYPE, "class").otherwise("property").alias("kind"), "necessity"
    )
    return terms.groupBy("question_id", "term", "kind").agg(F.max("necessity").alias("necessity"))  # 'required' > 'acceptable'


def schema_paths(patterns: DataFrame, schema: DataFrame) -> DataFrame:
    """Patterns (q, s, p, o, necessity) as distinct paths (q, class, property, necessity); class null: open.

    A subject's classes are those it is given, else the range of a property that it is an object of, if that is a class
    of the schema (the smallest range of a property); a constant subject is its own class. A path is required if any
    use of its property is.
    """
    from graphloom.functions.terms import RDF_TYPE

    types = patterns.where(F.col("p") == RDF_TYPE).select("q", "s", F.col("o").alias("t")).distinct()
    classes = schema.select(F.col("class").alias("t")).distinct()
    ranges = schema.groupBy(F.col("property").alias("p")).agg(F.min("range").alias("t")).join(classes, "t", "left_semi")
    reached = patterns.where(F.col("o").startswith("?")).join(ranges, "p").select("q", F.col("o").alias("s"), "t").distinct().join(
        types.select("q", "s").distinct(), ["q", "s"], "left_anti"
    )
    uses = patterns.where(F.col("p") != RDF_TYPE)
    necessity = uses.groupBy("q", "p").agg(F.max("necessity").alias("necessity"))  # 'required' > 'acceptable'
    variables = uses.where(F.col("s").startswith("?")).join(
        types.unionByName(reached), ["q", "s"], "left"
    ).select("q", F.col("t").alias("class"), "p")
    constants = uses.where(~F.col("s").startswith("?")).select("q", F.col("s").alias("class"), "p")
    return variables.unionByName(constants).distinct().join(necessity, ["q", "p"]).select(
        "q", "class", F.col("p").alias("property"), "necessity"
    )


def schema_truth(patterns: DataFrame, schema: DataFrame) -> DataFrame:
    """(q, class, property, range, necessity), the schema's rows that the closed paths run over."""
    return schema_paths(patterns, schema).join(
        schema.select("class", "property", "range").distinct(), ["class", "property"]
    ).select("q", "class", "property", "range", "necessity")


def score_paths(paths: DataFrame, retrieved: DataFrame, schema: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Paths of E24 that are retrieved (q, class, property): (q, coherence, matched, expected).

    A path counts if its own class's edge is there, or an open one if any class's is; else it counts once for each
    subclass that has the property, if any of those is there. Acceptable paths only count where matched.
    """
    edges = retrieved.select("q", "class", "property").distinct()
    direct = paths.join(edges.withColumn("here", F.lit(True)), ["q", "class", "property"], "left")
    anywhere = edges.select("q", "property", F.lit(True).alias("anywhere")).distinct()
    subs = ancestors.select(F.col("ancestor").alias("class"), F.col("child").alias("sub")).join(
        schema.select(F.col("class").alias("sub"), "property").distinct(), "sub"
    ).distinct()
    below = paths.join(subs, ["class", "property"]).join(
        edges.withColumnRenamed("class", "sub").withColumn("hit", F.lit(1)), ["q", "sub", "property"], "left"
    )
    below = below.groupBy("q", "class", "property").agg(F.count("hit").alias("k"), F.count(F.lit(1)).alias("n"))
    t = direct.join(anywhere, ["q", "property"], "left").join(below, ["q", "class", "property"], "left").na.fill(0, ["k", "n"])
    one = F.coalesce(F.when(F.col("class").isNull(), F.col("anywhere")).otherwise(F.col("here")), F.lit(False))
    t = t.withColumn("m", F.when(one, 1).otherwise(F.col("k"))).withColumn("e", F.when(one | (F.col("k") == 0), 1).otherwise(F.col("n")))
    need = F.sum(F.when(F.col("necessity") == "required", F.col("e")).otherwise(F.col("m")))
    return t.groupBy("q").agg(F.sum("m").alias("matched"), need.alias("expected")).select(
        "q", F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(F.lit(0.0)).alias("coherence"), "matched",
        "expected"
    )


def score_retrieval(patterns: DataFrame, retrieved: DataFrame, schema: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Patterns (q, reading, s, p, o, necessity) and retrieved (q, class, property, range): one row a question.

    The reading of best triple recall, then coherence; precision is that over the union of all readings. ``strict_f1``: the best
    reading's F1 with precision over all retrieved triples.
    """
    key = F.struct("q", "reading")
    asked = patterns.select(key.alias("q"), "s", "p", "o", "necessity")
    readings = asked.select("q").distinct()
    own = readings.join(retrieved.withColumnRenamed("q", "_q"), F.col("q.q") == F.col("_q")).drop("_q")
    truth = schema_truth(asked, schema)
    triples = score_triples(truth, own, ancestors)
    coherent = score_paths(schema_paths(asked, schema), own, schema, ancestors)
    union_truth = truth.groupBy(F.col("q.q").alias("q"), "class", "property", "range").agg(F.max("necessity").alias("necessity"))
    union_p = score_triples(union_truth, retrieved, ancestors).select("q", F.col("precision").alias("union_precision"))
    t = triples.join(coherent.select("q", "coherence"), "q", "left").na.fill(0.0, ["coherence"]).select(
        "q.q", "q.reading", "recall", "coherence", "strict_f1"
    ).join(union_p, "q")
    best = Window.partitionBy("q").orderBy(F.desc("recall"), F.desc("coherence"), "reading")
    t = t.withColumn("strict", F.max("strict_f1").over(Window.partitionBy("q"))).withColumn("r", F.row_number().over(best)).where("r = 1")
    p, r = F.col("union_precision"), F.col("recall")
    return t.select(
        "q", "reading", p.alias("precision"), "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"),
        "coherence", F.col("strict").alias("strict_f1")
    )


def score_triples(truth: DataFrame, retrieved: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Truth (q, class, property, range, necessity), retrieved (q, class, property, range); a subclass's triple matches its ancestor's."""
    up = ancestors.select(F.col("child").alias("class"), "ancestor").unionByName(
        retrieved.select("class", F.col("class").alias("ancestor"))
    ).distinct()
    lifted = retrieved.distinct().join(up, "class")
    met = lifted.join(truth.withColumnRenamed("class", "ancestor"), ["q", "ancestor", "property", "range"])
    found = met.groupBy("q").agg(
        F.count_distinct(F.when(F.col("necessity") == "required", F.struct("ancestor", "property", "range"))).alias("found"),
        F.count_distinct("class", "property", "range").alias("good")
    )
    need = truth.where("necessity = 'required'").groupBy("q").agg(F.count_distinct("class", "property", "range").alias("need"))
    known = retrieved.distinct().join(
        truth.select("q", "property").distinct(), ["q", "property"], "left_semi"
    ).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    total = retrieved.distinct().groupBy("q").agg(F.count(F.lit(1)).alias("n_all"))
    t = need.join(found, "q", "left").join(known, "q", "left").join(total, "q", "left").na.fill(0)
    strict = F.when(F.col("n_all") > 0, F.least(F.col("good") / F.col("n_all"), F.lit(1.0))).otherwise(F.lit(0.0))
    p = F.when(F.col("n") > 0, F.least(F.col("good") / F.col("n"), F.lit(1.0))).otherwise(F.lit(0.0))
    r = F.col("found") / F.col("need")
    f1 = lambda p: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return t.select(
        "q", p.alias("precision"), r.alias("recall"), f1(p).alias("f1"), strict.alias("strict_precision"), f1(strict).alias("strict_f1")
    )


def triple_terms(triples: DataFrame) -> DataFrame:
    """Classes and properties of retrieved (q, s, p, o) triples."""
    return triples.select(
        "q",
        F.explode(
            F.array(
                F.struct(F.lit("class").alias("kind"), F.col("s").alias("term")),
                F.struct(F.lit("property").alias("kind"), F.col("p").alias("term")),
                F.struct(F.lit("class").alias("kind"), F.col("o").alias("term"))
            )
        ).alias("x")
    ).select("q", "x.kind", "x.term").distinct()


def fingerprint(rows: DataFrame) -> DataFrame:
    """(pair, fingerprint, n_rows): equal for equal sets of rows, whatever their order; no rows are gathered."""
    own = rows.select("pair", "row").distinct()
    h = [F.xxhash64("row", F.lit(i)) for i in (1, 2)]
    return own.groupBy("pair").agg(
        F.concat_ws(":", F.hex(F.bit_xor(h[0])), F.hex(F.bit_xor(h[1])), F.count(F.lit(1)).cast("string")).alias("fingerprint"),
        F.count(F.lit(1)).alias("n_rows")
    )


def same_result(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 if both results are the same set, else 0."""
    both = pairs.select("pair").distinct().join(fingerprint(a), "pair", "left").join(
        fingerprint(b).select("pair", F.col("fingerprint").alias("other")), "pair", "left"
    )
    return both.select("pair", F.col("fingerprint").eqNullSafe(F.col("other")).cast("int").alias("correct"))


def result_tallies(runs: DataFrame) -> DataFrame:
    """Runs (purpose, correct 0/1/null, error) by purpose: all, correct, incorrect, failed, and the share that is correct.

    What isn't correct is incorrect if its error says "incorrect answer" or there is none, else failed.
    """
    right = F.coalesce(F.col("correct") == 1, F.lit(False))
    wrong = ~right & (F.coalesce("error", F.lit("incorrect answer")) == "incorrect answer")
    n = F.count(F.lit(1))
    return runs.groupBy("purpose").agg(
        n.alias("n"), F.count_if(right).alias("correct"), F.count_if(wrong).alias("incorrect"),
        (n - F.count_if(right) - F.count_if(wrong)).alias("failed"), (F.count_if(right) / n).alias("accuracy")
    )


def vote(results: DataFrame) -> DataFrame:
    """Results (question_id, candidate, text, fingerprint): the shortest text of the largest cluster."""
    size = results.groupBy("question_id", "fingerprint").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("question_id").orderBy(F.desc("votes"), F.length("text"), "text", "candidate")
    return results.join(size, ["question_id", "fingerprint"]).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def useful_tests(scores: DataFrame) -> DataFrame:
    """Tests (question_id, test, candidate, fingerprint, score) that score alike within every cluster."""
    t = scores.groupBy("question_id", "test", "fingerprint").agg(F.count_distinct("score").alias("k"))
    return t.groupBy("question_id", "test").agg(F.max("k").alias("k")).where("k <= 1").select("question_id", "test")


def pick_best(scores: DataFrame) -> DataFrame:
    """(question_id, candidate, score, fingerprint): highest score, then larger cluster, then candidate."""
    size = scores.groupBy("question_id", "fingerprint").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("votes"), "candidate")
    return scores.join(size, ["question_id", "fingerprint"]).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def agreement(results: DataFrame) -> DataFrame:
    """(question_id, fingerprint, ok, n_rows): share of the largest cluster and confidence."""
    size = results.groupBy("question_id", "fingerprint").agg(
        F.count(F.lit(1)).alias("k"), F.count_if("ok").alias("ok"), F.count_if(F.col("n_rows") > 0).alias("full")
    )
    t = size.groupBy("question_id").agg(
        (F.max("k") / F.sum("k")).alias("agreement"), F.count(F.lit(1)).alias("n_groups"), (F.sum("ok") / F.sum("k")).alias("syntax"),
        (F.sum("full") / F.sum("k")).alias("full")
    )
    return t.select(
        "question_id", "agreement", "n_groups",
        (0.3 * F.col("syntax") + 0.5 * F.col("agreement") + 0.2 * F.when(F.col("full") > 0, 1.0).otherwise(0.5)).alias("confidence")
    )


def select_best(cands: DataFrame) -> DataFrame:
    """(question_id, candidate, error, n_rows, confidence): the best by no error, rows, a moderate number of them, confidence.

    Totals are equal if nine digits are; the smaller candidate is taken then.
    """
    score = F.when(F.col("error").isNull(), 0.3).otherwise(0.0) + F.when(F.col("n_rows") > 0, 0.3).otherwise(0.0) + F.when(
        F.col("n_rows").between(1, 100), 0.2
    ).otherwise(0.0) + 0.2 * F.coalesce("confidence", F.lit(0.0))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("total", 9)), "candidate")
    return cands.withColumn("total", score).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def result_status(error: Column, n_rows: Column) -> Column:
    """E35."""
    return F.when(error.isNotNull(), "error").when(n_rows > 0, "ok").otherwise("empty")


def best_set(selected: DataFrame, solutions: DataFrame) -> DataFrame:
    """Selected (q, items), solutions (q, solution, items): the allowed set of best F1, precision, recall, each to nine digits."""
    both = selected.join(solutions.withColumnRenamed("items", "want"), "q")
    hit = F.size(F.array_intersect("items", "want"))
    scored = both.select("q", "solution", *_prf(hit, F.size(F.array_distinct("items")), F.size(F.array_distinct("want"))))
    order = Window.partitionBy("q").orderBy(*(F.desc(F.round(c, 9)) for c in ("f1", "precision", "recall")), "solution")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def rescore_tolerant(gt: DataFrame, sys: DataFrame, questions: DataFrame) -> DataFrame:
    """Tuple scores after the tolerant normal form of cells (pair, row_id, col, value); missing questions are 0."""
    from graphloom.functions.text import norm_tolerant

    rows = lambda df: df.withColumn("value", norm_tolerant(F.col("value"))).groupBy("pair", "row_id").agg(
        F.array_sort(F.collect_list(F.struct("col", "value"))).getField("value").alias("row")
    )
    return questions.select("pair").distinct().join(score_tuples(rows(gt), rows(sys)).select("pair", "f1"), "pair", "left").na.fill(0.0)


def compare_snapshots(
    spark, fns: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], a: dict[str, DataFrame], b: dict[str, DataFrame]
) -> DataFrame:
    """Each query on two snapshots: (pair, tp, fp, fn, precision, recall, f1, failed); one that can't be run on the second is failed, with scores of 0."""
    tag = lambda name, df: df.select(
        F.lit(name).alias("pair"), F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("row")
    )
    empty = spark.createDataFrame([], "pair string, row array<string>")
    one = reduce(DataFrame.unionByName, (tag(n, f(a)) for n, f in fns.items()), empty)
    two, failed = empty, []
    for name, f in fns.items():
        try:
            rows = tag(name, f(b))
            rows.isEmpty()  # fails here if its tables or columns are missing
            two = two.unionByName(rows)
        except Exception:  # whatever a query raises marks it
            failed.append(name)
    names = spark.createDataFrame([(n, n in failed) for n in fns], "pair string, failed boolean")
    return names.join(score_tuples(one, two), "pair", "left").na.fill(0, ["tp", "fp", "fn"]).na.fill(0.0, ["precision", "recall", "f1"])


def check_readings(spark, fns: dict[str, Callable[[], DataFrame]], datasets: dict[str, str] | None = None, samples: int = 3) -> DataFrame:
    """Each reading's dataset, number of rows, the first ``samples`` rows as texts, and yes (rows), partial (none) or failed.

    A reading that can't be run is a row with its error; each is run on its own for that.
    """
    out = []
    for name, f in fns.items():
        try:
            df = f()
            row = F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)))
            n = df.count()
            seen = sorted(r[0] for r in df.select(row).orderBy(row).limit(samples).collect())
            out.append(((datasets or {}).get(name), name, n, "yes" if n else "partial", seen, None))
        except Exception as e:  # whatever a reading raises is its result
            out.append(((datasets or {}).get(name), name, None, "failed", [], str(e)[:200]))
    return spark.createDataFrame(out, "dataset string, reading string, n_rows long, status string, samples array<string>, error string")


def readings_report(checked: DataFrame) -> DataFrame:
    """By dataset how many readings have rows, none, or failed."""
    return checked.groupBy("dataset").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("yes", "partial", "failed")))

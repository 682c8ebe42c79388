"""Reshaping of relational tables (H1-H9)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sizes import cut

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class ForeignKey:
    child: str
    parent: str
    child_col: str
    parent_col: str


def split_by_keys(tables: Tables, fks: list[ForeignKey], order: dict[str, str]) -> tuple[Tables, Tables]:
    """H1: two halves that keep keys together: root tables by their order column's lower half (at least one row), children with their parents.

    ``tables`` is in topological order. A root's border is its order column's exact value at n // 2, found in the one range that
    holds it, so nothing is ranked in one task; order columns are unique. Children of parents without rows in the first half
    go to the first half, as do tables whose order column has only nulls.
    """
    first: Tables = {}
    for name, df in tables.items():
        parents = [k for k in fks if k.child == name and k.parent in first]
        if parents:
            half = df
            for k in parents:
                keys = first[k.parent].select(F.col(k.parent_col).alias(k.child_col)).distinct()
                if not keys.isEmpty():
                    half = half.join(keys, k.child_col, "left_semi")
            first[name] = half
        else:
            border = nth(df, order[name], max(1, df.count() // 2))
            first[name] = df if border is None else df.where(F.col(order[name]) <= border)
    second = {n: df.join(first[n].select(order[n]), order[n], "left_anti") for n, df in tables.items()}
    return first, second


def ranges(df: DataFrame, col: str) -> DataFrame:
    """``df`` written in order of a column, with _range and the place _at in it: partitions are ranges of the column."""
    placed = df.repartitionByRange(col).sortWithinPartitions(col).withColumn("_id", F.monotonically_increasing_id())
    return cut(
        placed.select(*df.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    )


def nth(df: DataFrame, col: str, n: int):
    """The n-th smallest value (from 1) of a column: ranges are counted, one row of one range is read."""
    placed = ranges(df.where(F.col(col).isNotNull()).select(col), col)
    for r in sorted(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a range
        if n <= r["n"]:
            return placed.where((F.col("_range") == r["_range"]) & (F.col("_at") == n - 1)).first()[0]
        n -= r["n"]
    return None


def numbered(df: DataFrame, col: str, name: str = "nr") -> DataFrame:
    """``df`` with each row's place (from 1) by a unique column; only the counts of ranges are gathered."""
    placed = ranges(df, col)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return placed.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.col("_before") + F.col("_at") + 1).alias(name)
    )  # a row a range


def rename_table(df: DataFrame, colmap: dict[str, str]) -> DataFrame:
    """H2, H3: the rows under other column names."""
    return df.withColumnsRenamed(colmap)


def consolidate(tables: Tables, renames: dict[str, str]) -> Tables:
    """H4: old and new names both hold all rows."""
    return tables | {new: tables[old] for old, new in renames.items()}


def check_joins(halves: dict[str, Tables], fks: list[ForeignKey]) -> DataFrame:
    """H5: number of joined rows of each foreign key in each half."""
    parts = []
    for half, tables in halves.items():
        for k in fks:
            keys = tables[k.parent].select(F.col(k.parent_col).alias("_k"))
            joined = tables[k.child].select(F.col(k.child_col).alias("_k")).join(keys, "_k")
            parts.append(
                joined.agg(F.count(F.lit(1)).alias("n_joined")).select(
                    F.lit(half).alias("half"), F.lit(f"{k.child}->{k.parent}").alias("fk"), "n_joined"
                )
            )
    return reduce(DataFrame.unionByName, parts)


def profile_columns(name: str, df: DataFrame, keys: tuple[str, ...] = (), n: int = 3) -> DataFrame:
    """H6: per column its type, key flag, readable name, number of distinct values and the first n of them."""
    kinds = dict(df.dtypes)
    cells = df.select(
        *(F.col(c).cast("string").alias(c) for c in df.columns)
    ).unpivot([], df.columns, "col", "value").where("value is not null").distinct()
    # the first n of each task go to the window, not all values
    first = cells.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy("value"))).where(F.col("r") <= n)
    t = cells.groupBy("col").agg(F.count(F.lit(1)).alias("n_distinct")).join(
        first.groupBy("col").agg(F.array_sort(F.collect_list("value")).alias("samples")), "col"
    )
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("col")]
    return t.select(
        F.lit(name).alias("tbl"), "col", kind.alias("type"), F.col("col").isin(list(keys)).alias("is_key"),
        F.replace("col", F.lit("_"), F.lit(" ")).alias("readable"), "n_distinct", "samples"
    )


def entities(g: DataFrame, cls: str, props: dict[str, str]) -> DataFrame:
    """H7: one row an instance of a class, a column a property (smallest value), with an integer key by IRI order.

    The key is the IRI's rank, made from ranges of IRIs.
    """
    from graphloom.functions.terms import RDF_TYPE

    own = g.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)).select("s").distinct()
    facts = g.where(F.col("p").isin(list(props))).join(own, "s", "left_semi")
    wide = facts.groupBy("s").pivot("p", list(props)).agg(F.min("o")).withColumnsRenamed(props)
    return numbered(own.join(wide, "s", "left"), "s")


def link_table(g: DataFrame, prop: str) -> DataFrame:
    """H7: a multi-valued property as pairs."""
    return g.where(F.col("p") == prop).select("s", "o").distinct()


def linked_keys(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """H7: a link table (left_nr, right_nr) of the integer keys that ``entities`` gave both ends; ends that are no entities drop out."""
    met = links.join(left.select("s", F.col("nr").alias("left_nr")), "s")
    return met.join(right.select(F.col("s").alias("o"), F.col("nr").alias("right_nr")), "o").select("left_nr", "right_nr").distinct()


def coalesce_updates(log: DataFrame, columns: list[str]) -> DataFrame:
    """H8: log (key, seq, col, value): the last write of each known column, wide."""
    last = log.where(F.col("col").isin(columns)).groupBy("key", "col").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("key").pivot("col", columns).agg(F.first("value"))


def fit_width(rows: DataFrame, columns: list[tuple[str, str]], values: str = "values") -> DataFrame:
    """H9: rows (values array of strings) as ``columns`` [(name, type)]: longer rows are cut, shorter ones end in nulls; then filled.

    A value that its type can't hold is as a null.
    """
    cells = [F.try_element_at(values, F.lit(i + 1)) for i in range(len(columns))]
    blank = lambda c: F.when(~F.upper(F.trim(c)).isin("NULL", "NONE", "NAN"), c)
    return fill_null_like(rows.select(*(blank(c).try_cast(t).alias(n) for c, (n, t) in zip(cells, columns, strict=True))))


def fill_null_like(df: DataFrame) -> DataFrame:
    """H9: nulls and texts like NULL become '' or 0, by type."""
    out = []
    for c, t in df.dtypes:
        if t == "string":
            out.append(F.when(F.col(c).isNull() | F.upper(F.trim(c)).isin("NULL", "NONE", "NAN"), "").otherwise(F.col(c)).alias(c))
        elif t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal"):
            out.append(F.coalesce(c, F.lit(0).cast(t)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)

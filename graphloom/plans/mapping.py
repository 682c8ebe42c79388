"""Tables as triples by a declarative mapping.

A mapping is data: ``TriplesMap`` rows over named tables. Only the maps and columns that a
request needs are built, so Catalyst prunes the scans; references whose two sides have
one key join on that key before any IRI is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, XSD, from_template, template_columns
from graphloom.sizes import small

Tables = dict[str, DataFrame]
TRIPLE = ("s", "p", "o", "o_kind", "o_datatype", "o_lang")


@dataclass(frozen=True)
class Obj:
    """One predicate and its object: a column, a template, a constant or a reference to another map."""

    predicate: str
    column: str | None = None
    template: str | None = None
    literal: bool = False
    constant: str | None = None
    constant_literal: bool = False
    datatype: str | None = None
    lang: str | None = None
    ref: TriplesMap | None = None
    join: tuple[str, str] | None = None


@dataclass(frozen=True)
class TriplesMap:
    """A logical table (a name, or a view: a function of the tables), a subject template, classes and objects."""

    table: str | Callable[[Tables], DataFrame]
    subject: str
    classes: tuple[str, ...] = ()
    objects: tuple[Obj, ...] = ()

    def rows(self, tables: Tables) -> DataFrame:
        return tables[self.table] if isinstance(self.table, str) else self.table(tables)


def obj_col(predicate: str, column: str, datatype: str | None = None, lang: str | None = None) -> Obj:
    return Obj(predicate, column=column, datatype=datatype and (datatype if ":" in datatype else XSD + datatype), lang=lang)


def obj_tpl(predicate: str, template: str, literal: bool = False) -> Obj:
    return Obj(predicate, template=template, literal=literal)


def const(predicate: str, value: str, literal: bool = False) -> Obj:
    return Obj(predicate, constant=value, constant_literal=literal)


def ref(predicate: str, other: TriplesMap, child: str, parent: str) -> Obj:
    return Obj(predicate, ref=other, join=(child, parent))


def _triple(rows: DataFrame, s: Column, p: str, o: Column, iri: bool, datatype: str | None = None, lang: str | None = None) -> DataFrame:
    kinds = F.lit("iri" if iri else "literal"), F.lit(datatype).cast("string"), F.lit(lang).cast("string")
    return rows.select(
        s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), *(k.alias(n) for k, n in zip(kinds, TRIPLE[3:], strict=True))
    ).where("s is not null and o is not null")


def _object(rows: DataFrame, m: TriplesMap, o: Obj, tables: Tables) -> DataFrame:
    s = from_template(m.subject)
    if o.ref is not None:
        child, parent = o.join
        if template_columns(o.ref.subject) == [parent] and o.ref.table == m.table:
            return _triple(rows, s, o.predicate, from_template(o.ref.subject.replace(f"{{{parent}}}", f"{{{child}}}")), True)
        right = o.ref.rows(tables).select(F.col(parent).alias("_key"), from_template(o.ref.subject).alias("_o"))
        return _triple(
            rows.select(F.col(child).alias("_key"), s.alias("_s")).join(right, "_key"), F.col("_s"), o.predicate, F.col("_o"), True
        )
    if o.column is not None:
        return _triple(rows, s, o.predicate, F.col(o.column), False, o.datatype, o.lang)
    if o.template is not None:
        return _triple(rows, s, o.predicate, from_template(o.template, not o.literal), not o.literal)
    return _triple(rows, s, o.predicate, F.lit(o.constant), not o.constant_literal)


def triples(mapping: list[TriplesMap], tables: Tables, p: str | None = None, cls: str | None = None) -> DataFrame:
    """Triples of one predicate or class (or all), by the maps that can have them; not deduplicated."""
    parts = []
    for m in mapping:
        rows = m.rows(tables)
        parts += [
            _triple(
                rows, from_template(m.subject), RDF_TYPE, F.lit(c), True
            ) for c in m.classes if p in (None, RDF_TYPE) and cls in (None, c)
        ]
        parts += [_object(rows, m, o, tables) for o in m.objects if cls is None and p in (None, o.predicate)]
    if not parts:
        return SparkSession.active().createDataFrame([], ", ".join(f"{c} string" for c in TRIPLE))
    return reduce(DataFrame.unionByName, parts)


def materialize(mapping: list[TriplesMap], tables: Tables) -> DataFrame:
    """All triples, as a set."""
    return triples(mapping, tables).distinct()


def entail_types(graph: DataFrame, closure: DataFrame) -> DataFrame:
    """Adds the types that follow from ``closure`` (child, ancestor)."""
    types = graph.where(F.col("p") == RDF_TYPE)
    more = types.join(
        small(closure.select(F.col("child").alias("o"), "ancestor")), "o"
    ).withColumn("o", F.col("ancestor")).select(*graph.columns)
    return graph.unionByName(more).distinct()


def check_mapping(mapping: list[TriplesMap], tables: Tables) -> list[str]:
    """Template and object columns that a map's table doesn't have."""
    found = []
    for m in mapping:
        have = set(m.rows(tables).columns)
        used = [
            *template_columns(m.subject),
            *(c for o in m.objects for c in (template_columns(o.template or "") + ([o.column] if o.column else []) + ([o.join[0]] if o.join else [])))
        ]
        found += [f"{m.subject}: {c}" for c in used if c not in have]
    return found


def audit_templates(mapping: list[TriplesMap], tables: Tables) -> DataFrame:
    """For each subject template, its rows, IRIs and IRIs that stand for several keys."""
    parts = []
    for m in mapping:
        keys = template_columns(m.subject)
        by_iri = m.rows(tables).select(from_template(m.subject).alias("iri"), F.struct(*keys).alias("k")).where("iri is not null")
        by_iri = by_iri.groupBy("iri").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("keys"))
        parts.append(
            by_iri.agg(
                F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_iris"), F.count_if(F.col("keys") > 1).alias("collisions")
            ).select(F.lit(m.subject).alias("template"), "n_rows", "n_iris", "collisions")
        )
    return reduce(DataFrame.unionByName, parts)


def rename_terms(graph: DataFrame, renames: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """S, p and o renamed by exact term (old, new), else by namespace."""
    out = graph
    for c in ("s", "p", "o"):
        swap = small(renames.select(F.col("old").alias(c), F.col("new").alias("_new")))
        by_ns = F.col(c)
        for old, new in namespaces.items():
            by_ns = F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.substr(F.col(c), F.lit(len(old) + 1)))).otherwise(by_ns)
        out = out.join(swap, c, "left").withColumn(c, F.coalesce("_new", by_ns)).drop("_new")
    return out.select(*graph.columns)


def leftovers(graph: DataFrame, prefix: str) -> DataFrame:
    """Terms that still start with an old namespace."""
    return graph.select(F.explode(F.array("s", "p", "o")).alias("term")).where(F.col("term").startswith(prefix)).distinct()

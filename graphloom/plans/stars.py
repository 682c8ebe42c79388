"""Patterns over mapped tables, joined on keys (P1-P5, P17 on a mapping).

Patterns of one subject that one map answers are one projection of its table: a star. A variable
keeps the key columns of its template, so stars that share a variable of one template join on these; IRIs
are built last, from what is left. Only where templates differ are IRIs compared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, from_template, template_columns
from graphloom.operators.patterns import is_var
from graphloom.plans.mapping import Obj, Tables, TriplesMap


@dataclass(frozen=True)
class Term:
    """What a variable stands for: a template over columns of the solutions; ``iri`` percent-encodes."""

    template: str
    iri: bool

    @property
    def columns(self) -> list[str]:
        return template_columns(self.template)

    @property
    def shape(self) -> str:
        return re.sub(r"\{\w+\}", "{}", self.template)

    def text(self) -> Column:
        return from_template(self.template, self.iri) if self.columns else F.lit(self.template)

    def fits(self, other: Term) -> bool:
        """Whether the two may ever be equal: both IRIs or both literals, one's fixed start a start of the other's."""
        a, b = (x.template.split("{")[0] for x in (self, other))
        return self.iri == other.iri and (a.startswith(b) or b.startswith(a))

    @property
    def plain(self) -> bool:
        """Whether equal terms have equal keys: a single column, or none."""
        return len(self.columns) <= 1


class Solutions:
    """Rows with the key columns of their variables."""

    #: Whether another branch of the same map may give the same bindings.
    several = False

    def __init__(self, df: DataFrame, terms: dict[str, Term]):
        self.df, self.terms = df, terms

    def keys(self, var: str) -> list[str]:
        """The columns that tell a variable's values apart."""
        return self.terms[var].columns

    def text(self, var: str) -> Column:
        return self.terms[var].text()

    def bindings(self, *variables: str) -> DataFrame:
        """Variables as columns of texts."""
        return self.df.select(*(self.text(v).alias(v) for v in variables or self.terms))

    def where(self, condition: Column | str) -> Solutions:
        return Solutions(self.df.where(condition), self.terms)

    def join(self, other: Solutions, how: str = "inner") -> Solutions:
        """Natural join on shared variables; ``left`` keeps rows without a partner, ``left_anti`` only those."""
        common = [v for v in self.terms if v in other.terms]
        if not common:
            raise ValueError("patterns share no variable")
        conditions = []
        for v in common:
            a, b = self.terms[v], other.terms[v]
            if a.shape == b.shape and a.iri == b.iri and a.plain:
                conditions += [_equal(self.df, x, other.df, y) for x, y in zip(a.columns, b.columns, strict=True)]
            else:
                conditions.append(a.text() == b.text())
        # what the other side adds: columns of its own variables only
        own = {v: t for v, t in other.terms.items() if v not in self.terms} if how in ("inner", "left") else {}
        joined = self.df.join(other.df, reduce(Column.__and__, conditions) if conditions else F.lit(True), how)
        kept = [*self.df.columns, *dict.fromkeys(c for t in own.values() for c in t.columns)]
        return Solutions(joined.select(*kept), {**self.terms, **own})


def _equal(left: DataFrame, a: str, right: DataFrame, b: str) -> Column:
    x, y = left.schema[a].dataType, right.schema[b].dataType
    return F.col(a) == F.col(b) if x == y else F.col(a).cast("string") == F.col(b).cast("string")


class MappedGraph:
    """A mapping over tables, asked by patterns. Maps must have one row a subject (their key) for patterns that share one."""

    def __init__(self, mapping: list[TriplesMap], tables: Tables):
        self.mapping, self.tables, self.used = mapping, tables, 0

    def solve(self, patterns: list[tuple[str, str, str]]) -> Solutions:
        """All patterns, star by star; each star joins those that it shares a variable with. What no map answers has no rows."""
        stars: dict[str, list[tuple[str, str, str]]] = {}
        for p in patterns:
            stars.setdefault(p[0], []).append(p)
        found = self._pruned([[x for m in self.mapping for x in self._from(m, star)] or [self._none(star)] for star in stars.values()])
        parts = [self._merged(x) for x in found]
        done = parts.pop(0)
        while parts:
            at = next((i for i, x in enumerate(parts) if set(x.terms) & set(done.terms)), None)
            if at is None:
                raise ValueError("patterns share no variable")
            done = done.join(parts.pop(at))
        return done

    def _pruned(self, found: list[list[Solutions]]) -> list[list[Solutions]]:
        """Leaves out maps whose terms can't equal those of any map of another star; of none, an empty one stays."""
        while True:
            kept = [
                [
                    x for x in own if all(
                        any(
                            x.terms[v].fits(y.terms[v]) for y in other
                        ) for other in found if other is not own and other for v in set(x.terms) & set(other[0].terms)
                    )
                ] for own in found
            ]
            if [len(k) for k in kept] == [len(f) for f in found]:
                return found
            found = [k or [f[0].where(F.lit(False))] if f else k for k, f in zip(kept, found, strict=True)]

    def _merged(self, found: list[Solutions]) -> Solutions:
        """One projection if one map answers a star; else the union, with variables of one template still as keys."""
        if len(found) == 1:
            return found[0]
        several = any(x.several for x in found)
        terms, columns = {}, [[] for _ in found]
        for v in found[0].terms:
            own = [x.terms[v] for x in found]
            same = len({(t.shape, t.iri) for t in own}) == 1 and len(
                {tuple(x.df.schema[c].dataType for c in t.columns) for x, t in zip(found, own, strict=True)}
            ) == 1
            names = [self._name() for _ in own[0].columns] if same else [self._name()]
            for to, x, t in zip(columns, found, own, strict=True):
                to += [F.col(c).alias(n) for c, n in zip(t.columns, names, strict=True)] if same else [t.text().alias(names[0])]
            turn = iter(names)
            terms[v] = Term(
                re.sub(r"\{\w+\}", lambda _: f"{{{next(turn)}}}", own[0].template), own[0].iri
            ) if same else Term(f"{{{names[0]}}}", False)  # noqa: B023
        rows = reduce(DataFrame.unionByName, (x.df.select(*c) for x, c in zip(found, columns, strict=True)))
        return Solutions(rows.distinct() if several else rows, terms)

    def _none(self, patterns: list[tuple[str, str, str]]) -> Solutions:
        names = {v[1:]: self._name() for s, _, o in patterns for v in (s, o) if is_var(v)}
        empty = self.mapping[0].rows(self.tables).where(F.lit(False)).select(*(F.lit("").alias(n) for n in names.values()))
        return Solutions(empty, {v: Term(f"{{{n}}}", False) for v, n in names.items()})

    def _name(self) -> str:
        self.used += 1
        return f"k{self.used}"

    def _from(self, m: TriplesMap, patterns: list[tuple[str, str, str]]) -> list[Solutions]:
        """What a map answers: one branch for each choice of a class or object for every pattern.

        A map may have several for one pattern. Branches may then give the same bindings, which are one solution.
        """
        ways = [
            [*([c for c in m.classes if is_var(o) or c == o] if p == RDF_TYPE else []), *(x for x in m.objects if x.predicate == p)] for _,
            p, o in patterns
        ]
        found = [self._branch(m, patterns, way) for way in product(*ways)]
        for x in found:
            x.several = len(found) > 1
        return found

    def _branch(self, m: TriplesMap, patterns: list[tuple[str, str, str]], way: tuple[str | Obj, ...]) -> Solutions:
        rows = m.rows(self.tables)
        columns: dict[str, str] = {}  # new name -> the map's
        terms: dict[str, Term] = {}
        conditions: list[Column] = []

        def renamed(template: str) -> str:
            def new(match: re.Match) -> str:
                name = self._name()
                columns[name] = match[1]
                conditions.append(F.col(match[1]).isNotNull())
                return f"{{{name}}}"

            return re.sub(r"\{(\w+)\}", new, template)

        def take(term: str, template: str, iri: bool) -> None:
            """A constant filters, a variable is kept, one met again must be equal."""
            here = Term(template, iri).text()
            if not is_var(term):
                conditions.append(here == term)
            elif term[1:] in terms:
                before = terms[term[1:]]
                conditions.append(here == Term(re.sub(r"\{(\w+)\}", lambda k: f"{{{columns[k[1]]}}}", before.template), before.iri).text())
            else:
                terms[term[1:]] = Term(renamed(template), iri)

        take(patterns[0][0], m.subject, True)
        for (_, _, o), has in zip(patterns, way, strict=True):
            if not isinstance(has, str):
                template, iri, rows = self._object(m, has, rows)
                take(o, template, iri)
            elif is_var(o):
                take(o, has, True)
        kept = rows.where(reduce(Column.__and__, conditions)) if conditions else rows
        return Solutions(kept.select(*(F.col(c).alias(n) for n, c in columns.items())), terms)

    def _object(self, m: TriplesMap, o: Obj, rows: DataFrame) -> tuple[str, bool, DataFrame]:
        if o.ref is not None:
            child, parent = o.join
            template = o.ref.subject
            if template_columns(template) == [parent]:
                # the parent must exist; its key is the child's column
                there = o.ref.rows(self.tables).select(F.col(parent).alias("_parent")).distinct()
                kept = rows if o.ref.table == m.table else rows.join(there, F.col(child) == F.col("_parent"), "left_semi")
                return template.replace(f"{{{parent}}}", f"{{{child}}}"), True, kept
            names = {c: f"_{self._name()}" for c in template_columns(template)}
            there = o.ref.rows(self.tables).select(F.col(parent).alias("_parent"), *(F.col(c).alias(n) for c, n in names.items()))
            return re.sub(
                r"\{(\w+)\}", lambda k: f"{{{names[k[1]]}}}", template
            ), True, rows.join(there, F.col(child) == F.col("_parent")).drop("_parent")
        if o.column is not None:
            return f"{{{o.column}}}", False, rows
        if o.template is not None:
            return o.template, not o.literal, rows
        return o.constant, not o.constant_literal, rows

"""Secret scan by a trigram inverted index, with DataFrame functions only.

Each rule's regex is turned into a Boolean query over trigrams of the lower-cased
text. Postings (trigram, row) of the trigrams that the queries name are intersected
by counting, and only candidate rows are searched with the rule's regex. A rule
without mandatory trigrams (hex) is searched in every row.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, free, small


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` of the match must have at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base kinds. A match of access or hex is a whole run, so its least length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds, public formats of credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"
#: Alternatives that a query may have; a larger one is weakened.
MOST = 64

Query = frozenset[frozenset[str]]


def _minimal(query: Iterable[frozenset[str]]) -> Query:
    """Without alternatives that another one implies."""
    q = set(query)
    return frozenset(x for x in q if not any(y < x for y in q))


def _strings(node) -> set[str] | None:
    """All lower-cased texts of a parsed item if they are few, else None."""
    op, arg = node
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.AT:
        return {""}
    if op is ops.IN:
        if all(x[0] is ops.LITERAL for x in arg) and len(arg) <= 8:
            return {chr(x[1]).lower() for x in arg}
        return None
    if op is ops.SUBPATTERN:
        return _join(arg[-1])
    if op is ops.BRANCH:
        found = [_join(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op is ops.MAX_REPEAT and arg[1] <= 8:
        once, out = _join(arg[2]), set()
        for n in range(arg[0], int(arg[1]) + 1):
            out |= set() if once is None else reduce(lambda a, b: {x + y for x in a for y in b} if len(a) * len(b) <= MOST else set(), [once] * n, {""})
        return out if once is not None and out and len(out) <= MOST else None
    return None


def _join(items) -> set[str] | None:
    out = {""}
    for node in items:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST:
            return None
        out = {x + y for x in out for y in more}
    return out


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams that a matching text must have; the empty alternative: no mandatory ones."""

    def of_texts(texts: set[str]) -> Query:
        return _minimal(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)

    def both(a: Query, b: Query) -> Query:
        if len(a) * len(b) > MOST:
            return min(a, b, key=len)
        return _minimal(x | y for x in a for y in b)

    def walk(items) -> Query:
        query, run = frozenset([frozenset()]), {""}
        for node in items:
            texts = _strings(node)
            if texts is not None and len(run) * len(texts) <= MOST:
                run = {x + y for x in run for y in texts}
                continue
            query, run = both(query, of_texts(run)), {""}
            op, arg = node
            if op is ops.SUBPATTERN:
                query = both(query, walk(arg[-1]))
            elif op is ops.MAX_REPEAT and arg[0] > 0:
                query = both(query, walk(arg[2]))
            elif op is ops.BRANCH:
                query = both(query, _minimal(x for branch in arg[1] for x in walk(branch)))
        return both(query, of_texts(run))

    return walk(parser.parse(pattern))


#: Letters from frequent to rare in plain text; all else is rarer.
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def gates_of(alternatives: list[set[str]]) -> list[str]:
    """Few trigrams of which each alternative has one: those of most alternatives first, then the rarest."""
    rarity = lambda t: sum(LETTERS.index(c) if c in LETTERS else len(LETTERS) for c in t)
    left, gates = [a for a in alternatives if a], []
    while left:
        best = max(sorted(set().union(*left)), key=lambda t: (sum(t in a for a in left), rarity(t)))
        gates.append(best)
        left = [a for a in left if best not in a]
    return gates


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_row, _mask): bit i is set where the index doesn't rule out rule i. Rules that scan fully are left out."""
    clauses = [(i, k, t, len(c)) for i, r in enumerate(rules) for k, c in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in c if frozenset() not in trigram_query(r.pattern)]
    if not clauses:
        return rows.sparkSession.createDataFrame([], "_row long, _mask long")
    wanted = rows.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, terms int")
    own: dict[tuple[int, int], set[str]] = {}
    for rule, clause, t, _ in clauses:
        own.setdefault((rule, clause), set()).add(t)
    gates = gates_of(list(own.values()))
    # an alternative without its gate is lost, so its other trigrams are only looked for behind it
    behind = {t: [g for g in gates if any(g in c and t in c for c in own.values())] for c in own.values() for t in c if t not in gates}
    looked = rows.select("_row", F.lower("_text").alias("_lower")).select("_row", "_lower", *(F.contains("_lower", F.lit(g)).alias(f"_gate{i}") for i, g in enumerate(gates)))
    open_ = lambda t: reduce(Column.__or__, (F.col(f"_gate{gates.index(g)}") for g in behind[t]))
    found = [F.when(F.col(f"_gate{i}"), F.lit(g)) for i, g in enumerate(gates)] + [F.when(open_(t) & F.contains("_lower", F.lit(t)), F.lit(t)) for t in sorted(behind)]
    passed = looked.where(reduce(Column.__or__, (F.col(f"_gate{i}") for i in range(len(gates)))))
    postings = passed.select("_row", F.explode(F.array_compact(F.array(*found))).alias("trigram"))
    met = (
        postings.join(F.broadcast(wanted), "trigram")  # the clauses depend on the rules alone
        .groupBy("_row", "rule", "clause", "terms")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = terms")
    )
    return met.groupBy("_row").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("_mask"))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    kind = F.lit(rule.kind)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["found"])
        one = F.array(F.struct(at.alias("start"), F.lit(order).alias("order"), kind.alias("kind"), end.alias("end")))
        kept = F.when(F.length(x["held"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), held.alias("held"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(zipped, zero, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: array of (start, order, kind, end), by start, then by the rules' order.

    Offsets count code points, ``end`` is exclusive. Null and empty texts have no spans. Rows
    are keyed by a hash of id and text, so null ids and repeated rows keep their own rows. A
    column of ``docs`` with the name of ``spans_col`` is replaced, all others stay. Candidates are broadcast if they are
    few, else joined by a shuffle.
    """
    kept = [c for c in docs.columns if c.lower() != spans_col.lower()]
    text, row, mask_col = (free(docs.columns, c) for c in ("_text", "_row", "_mask"))
    keyed = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(row, F.xxhash64(F.col(id_col), F.col(text)))
    mask = small(cut(candidates(keyed.select(F.col(row).alias("_row"), F.col(text).alias("_text")), rules))).toDF(row, mask_col)
    scanned = keyed.join(mask, row, "left")
    none = F.array().cast(SPANS)
    found = []
    for i, rule in enumerate(rules):
        spans = rule_spans(F.col(text), rule, i)
        if frozenset() in trigram_query(rule.pattern):
            found.append(F.when(F.regexp_like(F.col(text), F.lit(rule.pattern)), spans).otherwise(none))
        else:
            hit = F.coalesce(F.col(mask_col), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
            found.append(F.when(hit, spans).otherwise(none))
    return scanned.select(*(F.col(f"`{c}`") for c in kept), F.array_sort(F.concat(*found)).alias(spans_col))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, *, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mark`` in the text.

    Rows without secrets keep their text, null texts stay null; the columns are those of ``docs``.
    """
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.lit((1 << 31) - 1)
    spans = free(docs.columns, "spans")
    rebuilt = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, end)))
    scanned = find_secrets(docs, rules=rules, id_col=id_col, text_col=text_col, spans_col=spans)
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, rebuilt).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))

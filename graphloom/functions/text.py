"""Normal forms and classes of texts and values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from graphloom.functions.terms import local_value


@pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@pandas_udf(StringType())
def _six_digits(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else f"{x:.6g}")


def norm_text(col: Column, nfc: bool = False) -> Column:
    """White space off both ends, composed with ``nfc`` (Python only where a value isn't ASCII), lower case."""
    text = stripped(col)
    if nfc:
        text = F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)
    return F.lower(text)


def try_double(col: Column) -> Column:
    return col.try_cast("double")


def stripped(col: Column) -> Column:
    """Without white space at both ends, that of Unicode and the four separators from 0x1C too."""
    return F.regexp_replace(col.cast("string"), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


#: Texts that are numbers: an optional sign, digits with at most one point, an exponent.
DECIMAL = r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"
FLOAT = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)$"


def is_float(col: Column) -> Column:
    return stripped(col).rlike(FLOAT)


def norm_number(col: Column) -> Column:
    """Stripped; a number without superfluous zeros, plus sign and exponent, all else in lower case.

    Plain numbers keep all their digits; those with an exponent must fit 20 digits before and 18 after the point.
    """
    text = stripped(col)
    digits = F.when(F.contains(F.lower(text), F.lit("e")), text.try_cast("decimal(38,18)").cast("string")).otherwise(text)
    # an exponent beyond that stays as it is
    digits = F.coalesce(digits, text)
    sign = F.regexp_extract(digits, r"^-", 0)
    whole = F.regexp_replace(F.regexp_extract(digits, r"^[+-]?(\d*)", 1), "^0+(?=.)", "")
    rest = F.regexp_replace(F.regexp_extract(digits, r"^[+-]?\d*\.(\d*)$", 1), "0+$", "")
    plain = F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    infinite = F.regexp_replace(F.lower(text), r"^\+?(-?)inf(?:inity)?$", "$1infinity")
    return F.when(digits.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), plain).otherwise(infinite)


def norm_tolerant(col: Column) -> Column:
    """Blank is '', a number its absolute value with six digits, a web IRI its decoded last segment; composed and in lower case."""
    text = F.coalesce(stripped(col), F.lit(""))
    text = F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)
    number = F.when(text.rlike(FLOAT), text.try_cast("double"))
    return F.lower(
        F.when(text == "", "").when(
            number.isNotNull(), _six_digits(F.abs(number))
        ).when(text.rlike("^https?://"), local_value(text)).otherwise(text)
    )


#: Values that carry no information (fixed values).
TRIVIAL = [
    "0", "0.0", "0.00", "0.000", "0.0000", "0.00000", "0.000000", "", "null", "none", "n/a", "na", "nil", "true", "false", "yes", "no", "1",
    "unknown", "undefined", "other", "-", "--", "..."
]


def is_trivial(col: Column) -> Column:
    """A value of the list, null, or any number that is zero."""
    text = F.lower(stripped(col))
    zero = F.when(text.rlike(DECIMAL), text.try_cast("double") == 0)
    return col.isNull() | F.coalesce(text.isin(TRIVIAL) | F.coalesce(zero, F.lit(False)), F.lit(False))


#: Forms of dates and times that count as temporal: date; date and time joined by T (Z may follow) or a blank; time; year; year and month (fixed values).
_DAY, _TIME = r"(?!0000)\d{4}-(?:1[0-2]|0?[1-9])-(?:3[01]|[12]\d|0?[1-9])", r"(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d"
TEMPORAL = rf"^(?:{_DAY}(?:T{_TIME}Z?| {_TIME})?|{_TIME}|(?!0000)\d{{4}}|(?!0000)\d{{4}}-(?:1[0-2]|0?[1-9]))$"


def is_temporal(col: Column) -> Column:
    """A date or time of the fixed forms; the day must exist."""
    day = F.regexp_extract(col, rf"^({_DAY})", 1)
    return col.rlike(TEMPORAL) & ((day == "") | F.try_to_timestamp(day, F.lit("yyyy-M-d")).isNotNull())


def infer_kind(cells: DataFrame, most: int = 100) -> DataFrame:
    """(col, kind) by up to ``most`` distinct values a column that aren't blank: numeric, temporal or none.

    Any of a column's values may be those; the first by order are, so reruns agree. A bare year is numeric unless
    dates of another form stand beside it. Columns without values are missing.
    """
    from pyspark.sql import Window

    ranked = cells.where(stripped(F.col("value")) != "").select("col", "value").distinct()
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy("value"))).where(F.col("r") <= most)
    flags = ranked.groupBy("col").agg(
        F.bool_and(is_float(F.col("value"))).alias("num"), F.bool_and(is_temporal(F.col("value"))).alias("temp")
    )
    return flags.select("col", F.when(F.col("num"), "numeric").when(F.col("temp"), "temporal").otherwise("none").alias("kind"))


def literal_kind(col: Column, datatype: Column) -> Column:
    """Numeric by the datatype's name, temporal by the value's start (time or date), else string."""
    numeric = F.coalesce(datatype, F.lit("")).rlike("integer|decimal|float|double")
    return F.when(numeric, "numeric").when(col.rlike(r"^\d{2}:\d{2}:\d{2}|^\d{4}-\d{2}-\d{2}"), "temporal").otherwise("string")


def query_features(log: DataFrame, col: str = "query") -> DataFrame:
    """Which clauses a query text has, and how many aggregates."""
    words = {
        "limit": "LIMIT", "filter": "FILTER", "grouped": "GROUP\\s+BY", "ordered": "ORDER\\s+BY", "is_distinct": "DISTINCT",
        "has_optional": "OPTIONAL", "has_union": "UNION", "subquery": "\\{\\s*SELECT"
    }
    flags = [F.col(col).rlike(f"(?i)\\b{w}" if w[0] != "\\" else f"(?i){w}").alias(n) for n, w in words.items()]
    aggregates = F.size(F.regexp_extract_all(F.col(col), F.lit(r"(?i)\b(COUNT|SUM|AVG|MIN|MAX|SAMPLE|GROUP_CONCAT)\s*\("), F.lit(1)))
    return log.select("*", *flags, aggregates.alias("n_aggregates"))


#: Error classes by what a message holds, first match wins (fixed values).
ERRORS = [
    ("TIMEOUT", "(?i)timeout|execution time exceeded"),
    ("SQL_SERIALIZATION_ERROR", "SQLSerializationException"),
    ("INTERNAL_ERROR", "NullPointerException"),
    ("UNSUPPORTED_PROPERTY_PATH", "ArbitraryLengthPath|Unsupported arbitrary length path"),
    ("UNION_MAPPING_BUG", "Multiple entries with same key: UNION"),
    ("COLUMN_ID_ERROR", "does not appear in columnIDs"),
    ("SYNTAX_ERROR", "(?i)syntax|parse"),
]


def _first_match(col: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in rules:
        out = out.when(col.rlike(pattern), name)
    return out.otherwise(default)


def error_class(col: Column) -> Column:
    """The class of a message; null and unknown ones are UNKNOWN."""
    return _first_match(col, ERRORS, "UNKNOWN")


#: Levels of complexity by the clauses of a query's text (fixed values).
LEVELS = [
    ("VERY_HARD", "SERVICE"), ("HARD", "HAVING|NOT EXISTS|MINUS"), ("HARD", "FILTER *[(] *! *BOUND"),
    ("MEDIUM", "GROUP BY|COUNT|SUM|AVG|OPTIONAL")
]


def complexity(col: Column) -> Column:
    """SIMPLE, MEDIUM, HARD or VERY_HARD by the words that a query's text holds, in any case; a null text is SIMPLE."""
    return _first_match(F.upper(col), LEVELS, "SIMPLE")


#: Patterns of a ranked query's order and limit, of a note's pair ``right -> wrong``, and of a literal or bare number (fixed values).
ORDER_BY, LIMIT = r"(?i)ORDER\s+BY\s+(?:(DESC|ASC)\s*)?\(?\s*\??(\w+)", r"(?i)LIMIT\s+(\d+)"
TYPO_PAIR = r"[A-Za-z][A-Za-z '\-]*?\s*->\s*([A-Za-z][A-Za-z '\-]*)"
LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[a-z\-]+|\^\^\S+)?|(?<=\s)-?\d+(?:\.\d+)?(?=\s*[;,.])'


def ranked(col: Column) -> Column:
    """Struct of the first ORDER BY name (with or without ?), direction and limit; null unless ORDER BY and LIMIT are there."""
    limit = F.regexp_extract(col, LIMIT, 1)
    var = F.regexp_extract(col, ORDER_BY, 2)
    direction = F.when(F.upper(F.regexp_extract(col, ORDER_BY, 1)) == "DESC", "desc").otherwise("asc")
    return F.when(
        (var != "") & (limit != ""), F.struct(var.alias("variable"), direction.alias("direction"), limit.try_cast("int").alias("n"))
    )


#: Classes of ambiguity by what a question's notes hold (fixed values), and what sets without such notes are.
AMBIGUITY = [
    ("case_variation", "case variation"), ("partial_match", "partial match"), ("synonym", "synonym"), ("temporal", "temporal"),
    ("fuzzy_typo", "fuzzy|typo"),
    ("abbreviation", "abbreviation"), ("numeric_filter", "numeric filter"), ("multi_step", "multi-step"),
    ("semantic_variance", "semantic variance"),
    ("role_ambiguity", "^(?=.*ambiguity)(?=.*(role|owns|responsible))"), ("activity_ambiguity", "^(?=.*ambiguity)(?=.*active)"),
    ("underspecified", "ambiguity|underspecified"),
]
#: Categories of tools by what their names hold (fixed values).
TOOLS = [
    ("retrieval", "search|grep|find|retrieve"), ("sparql", "sparql|query|execute"), ("validation", "validate|check|verify"),
    ("data_access", "sample|instance|data")
]


def ambiguity(notes: Column, query_set: Column) -> Column:
    """Sets A and B are none and D cross_dataset; others go by their notes, then C is partial_match, E semantic_variance, the rest none."""
    found = _first_match(F.regexp_replace(F.lower(F.coalesce(notes, F.lit(""))), r"\s", " "), AMBIGUITY, "")
    rest = F.when(query_set == "C", "partial_match").when(query_set == "E", "semantic_variance").otherwise("none")
    return F.when(query_set.isin("A", "B"), "none").when(query_set == "D", "cross_dataset").when(found != "", found).otherwise(rest)


def tool_category(col: Column) -> Column:
    """Retrieval, sparql, validation, data_access or other."""
    return _first_match(F.lower(col), TOOLS, "other")


def typo_hits(calls: DataFrame, notes: DataFrame) -> DataFrame:
    """Pairs ``right -> wrong`` in notes (question_id, note); (run_id, question_id, typo, hit) of each call text and misspelling, found as whole words."""
    found = notes.select("question_id", F.explode(F.regexp_extract_all("note", F.lit(TYPO_PAIR), F.lit(1))).alias("typo"))
    found = found.select("question_id", F.lower(stripped(F.col("typo"))).alias("typo")).distinct()
    return calls.join(found, "question_id").select(
        "run_id", "question_id", "typo", F.expr("coalesce(lower(text) rlike concat('\\\\b', typo, '\\\\b'), false)").alias("hit")
    )


def mask_literals(col: Column) -> Column:
    """Quoted literals (with datatype or language), and bare numbers before a ; , or . become xsd:string."""
    return F.regexp_replace(col, LITERAL, "xsd:string")


def expand_camel(col: Column) -> Column:
    """L2: a blank at each change from lower to upper case."""
    return F.regexp_replace(col, "([a-z])([A-Z])", "$1 $2")

"""What a question's patterns need from retrieval (E23): classes, properties and instances, required or acceptable.

Patterns are rows (question_id, reading_id, block, s, p, o, o_kind, o_datatype): ``block`` is main, optional or minus, variables begin
with a question mark, ``o_kind`` is iri, literal or variable. Filters are rows (question_id, reading_id, block, variable, op,
value, value_kind, value_datatype), one for each constant. What only optional blocks use is acceptable; minus blocks and
filters outside optional ones are required. What any pattern of any reading requires is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE
from graphloom.functions.text import literal_kind

KEYS = ("question_id", "kind", "term", "value_type", "associated_class", "associated_property")


def _need(block: str = "block") -> Column:
    return F.when(F.col(block) == "optional", "acceptable").otherwise("required").alias("necessity")


def retrieval_elements(patterns: DataFrame, filters: DataFrame | None = None, schema_namespaces: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, kind, term, value_type, associated_class, associated_property, necessity), one row for each element.

    Classes are objects of rdf:type and IRIs that a filter IN allows for a type variable; properties are other constant
    predicates; instances are constants as subject or object of a property, but for IRIs of the schema's namespaces, and
    constants of filters. A literal is told numeric, temporal or string, and an instance has the property it stands with and the
    smallest class of the variable beside it, if known.
    """
    null = F.lit(None).cast("string")
    at = ("question_id", "reading_id")
    is_type, constant = F.col("p") == RDF_TYPE, ~F.col("p").startswith("?")
    p = patterns.where(constant)

    def rows(
        df: DataFrame, kind: str, term: Column, value_type: Column = null, cls: Column = null, prop: Column = null,
        need: Column | None = None
    ) -> DataFrame:
        return df.select(
            "question_id", F.lit(kind).alias("kind"), term.alias("term"), value_type.alias("value_type"), cls.alias("associated_class"),
            prop.alias("associated_property"), need if need is not None else _need()
        )

    parts = [rows(p.where(is_type & (F.col("o_kind") == "iri")), "class", F.col("o")), rows(p.where(~is_type), "property", F.col("p"))]
    # a variable's class, in any block of its query
    classes = patterns.where(
        is_type & (F.col("o_kind") == "iri") & F.col("s").startswith("?")
    ).groupBy(*at, F.col("s").alias("v")).agg(F.min("o").alias("cls"))
    known = F.lit(False)
    for ns in schema_namespaces:
        known = known | F.col("term").startswith(ns)
    own = p.where(~is_type)
    ends = rows(own.where(~F.col("s").startswith("?")), "instance", F.col("s"), F.lit("uri"), prop=F.col("p")).unionByName(
        rows(own.where(F.col("o_kind") == "iri"), "instance", F.col("o"), F.lit("uri"), prop=F.col("p"))
    )
    parts.append(ends.where(~known))
    literals = own.where(F.col("o_kind") == "literal").join(classes.withColumnRenamed("v", "s"), [*at, "s"], "left")
    parts.append(rows(literals, "instance", F.col("o"), literal_kind(F.col("o"), F.col("o_datatype")), F.col("cls"), F.col("p")))
    if filters is not None:
        typed = patterns.where(is_type & (F.col("o_kind") == "variable")).select(*at, F.col("o").alias("variable")).distinct()
        allowed = (F.col("op") == "IN") & (F.col("value_kind") == "iri")
        parts.append(rows(filters.where(allowed).join(typed, [*at, "variable"], "left_semi"), "class", F.col("value")))
        # the property whose object the filtered variable is, and its subject's class
        uses = own.where(F.col("o_kind") == "variable").select(
            *at, F.col("o").alias("variable"), F.col("s").alias("v"), "p"
        ).join(classes, [*at, "v"], "left")
        use = uses.groupBy(*at, "variable").agg(F.min(F.struct("p", "cls")).alias("use"))
        others = filters.join(typed, [*at, "variable"], "left_anti").join(use, [*at, "variable"], "left")
        kind = F.when(F.col("value_kind") == "iri", "uri").otherwise(literal_kind(F.col("value"), F.col("value_datatype")))
        parts.append(rows(others, "instance", F.col("value"), kind, F.col("use.cls"), F.col("use.p")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*KEYS).agg(F.max("necessity").alias("necessity"))  # 'required' > 'acceptable'

"""Terms of a graph: templates, local names and namespaces as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def template_columns(template: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", template)


def from_template(template: str, encode: bool = True) -> Column:
    """Text with ``{column}`` parts; a null part gives null. In IRIs all but letters, digits and - . _ ~ is percent-encoded."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            value = F.col(piece).cast("string")
            parts.append(_encoded(value) if encode else value)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _encoded(value: Column) -> Column:
    """Spark encodes as forms do: a blank is a plus there, a tilde is encoded and an asterisk isn't."""
    out = F.url_encode(value)
    for form, iri in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(form), F.lit(iri))
    return out


def local_value(col: Column) -> Column:
    """The last path segment, percent-decoded (a plus sign stays one)."""
    last = F.element_at(F.split(col, "/"), -1)
    return F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def local_name(col: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(col, r"([^#/]*)$", 1)


def namespace(col: Column) -> Column:
    """All up to and with the last # or /."""
    return F.regexp_replace(col, r"[^#/]*$", "")

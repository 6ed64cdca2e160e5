"""Column functions on identifiers: shape, parts, brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_uri(col: Column) -> Column:
    return F.contains(col, F.lit("://"))


def is_curie(col: Column) -> Column:
    return F.contains(col, F.lit(":")) & ~is_uri(col)


def id_kind(col: Column) -> Column:
    """Form of an identifier: uri, curie or unknown."""
    return F.when(is_uri(col), "uri").when(is_curie(col), "curie").otherwise("unknown")


def curie_prefix(col: Column) -> Column:
    """Text before the first colon; NULL without a colon."""
    return F.when(F.contains(col, F.lit(":")), F.substring_index(col, ":", 1))


def local_name(col: Column) -> Column:
    """Text after the first colon; the whole text without one."""
    return F.substring(col, F.instr(col, ":") + 1, F.length(col))


def iri_tail(col: Column) -> Column:
    """Last segment after '#' or '/'."""
    return F.regexp_extract(col, r"([^#/]*)$", 1)


def strip_brackets(col: Column) -> Column:
    return F.regexp_replace(col, r"^<(.+)>$", "$1")


def id_tokens(col: Column) -> Column:
    """Tokens of a composite "iri version-iri" identifier."""
    return F.split(F.trim(F.regexp_replace(col, r"[ \t]+", " ")), " ")


def first_id_token(col: Column) -> Column:
    return F.element_at(id_tokens(col), 1)


def last_id_token(col: Column) -> Column:
    return F.element_at(id_tokens(col), -1)


def canonical_id(col: Column) -> Column:
    return strip_brackets(F.trim(col))

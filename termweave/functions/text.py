"""Column functions on literals, axiom values and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave import constants as K


def literal_text(col: Column) -> Column:
    """Text of a label literal: "x"@en, "x" and x all give x; blank gives NULL."""
    value = F.trim(col)
    tagged = F.regexp_extract(value, r'^"([^"]*)"@([A-Za-z][-A-Za-z0-9]*)$', 1)
    plain = F.regexp_extract(value, r'^"([^"]*)"$', 1)
    return (
        F.when(value.rlike(r'^"[^"]*"@[A-Za-z][-A-Za-z0-9]*$'), tagged)
        .when(value.rlike(r'^"[^"]*"$'), plain)
        .when(value != "", value)
    )


def literal_lang(col: Column) -> Column:
    """Language tag of a label literal, NULL without one."""
    tag = F.regexp_extract(F.trim(col), r'^"[^"]*"@([A-Za-z][-A-Za-z0-9]*)$', 1)
    return F.when(tag != "", tag)


def match_form(col: Column) -> Column:
    """Form for lenient label equality: no tag or datatype, no quotes, lower case."""
    bare = F.regexp_replace(col, r"(?:@[A-Za-z0-9-]+|\^\^.*)$", "")
    return F.lower(F.regexp_replace(bare, r'^"(.*)"$', "$1"))


def tsv_safe(col: Column) -> Column:
    """One tab-separated field: no tabs, and line breaks shown as ` / `."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"\r$", "")
    return F.regexp_replace(F.replace(out, F.lit("\t"), F.lit(" ")), r"[\r\n]+", " / ")


def balanced_parentheses(col: Column) -> Column:
    """Whether parentheses balance and never close before they open.

    Nested innermost pairs would need repeated rewriting; a running depth over the
    parentheses alone needs one pass. Depth -1 is kept, so an early `)` is never repaid.
    """
    marks = F.split(F.regexp_replace(col, r"[^()]", ""), "")
    depth = F.aggregate(
        marks,
        F.lit(0),
        lambda acc, ch: F.when(acc < 0, acc)
        .when(ch == "(", acc + 1)
        .when(ch == ")", acc - 1)
        .otherwise(acc),
    )
    return depth == 0


def axiom_words(value: Column) -> Column:
    """CURIE-shaped words of an axiom value."""
    words = F.split(value, r"[ \n\t,]+")
    return F.filter(words, lambda w: w.rlike(K.AXIOM_CURIE) & ~w.rlike(r"^https?://"))


def axiom_leaves(keyword: Column, value: Column) -> Column:
    """Bare-CURIE leaves of an axiom value; property chains split on ` o `."""
    parts = F.when(keyword == "SubPropertyChain", F.split(value, r"\s+o\s+")).otherwise(
        F.split(value, r"[,\n]"))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")),
                    lambda p: p.rlike(K.LEAF_CURIE))


# Name characters that bound a whole token. Checks count '.' and '/', edits count ':'.
CHECK_NAME = r"-_./A-Za-z0-9"
EDIT_NAME = r"-_:A-Za-z0-9"


def mentions(value: Column, curie: Column, name_class: str = CHECK_NAME) -> Column:
    """Whether `value` holds `curie` as a whole token; both are columns."""
    quoted = F.concat(F.lit("\\Q"), curie, F.lit("\\E"))
    pattern = F.concat(F.lit(f"(?:^|[^{name_class}])"), quoted, F.lit(f"(?:[^{name_class}]|$)"))
    return F.contains(value, curie) & F.call_function("rlike", value, pattern)


def normal_space(col: Column) -> Column:
    """Text with runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col, r"[ \t\n\r]+", " "))


def slug(label: Column) -> Column:
    """Lower-case ASCII slug joined with hyphens; `x` when nothing is left."""
    ascii_only = F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(ascii_only, r"^-+|-+$", "")
    return F.when(trimmed == "", "x").otherwise(trimmed)


def entity_from_heading(title: Column) -> Column:
    """Identifier a heading declares. The first shape that matches wins."""
    curie, iri = K.HEAD_CURIE, K.HEAD_IRI

    def group(pattern: str, n: int = 1) -> Column:
        return F.regexp_extract(title, pattern, n)

    shapes = [
        (rf"(?m)^<?({iri})>?", lambda p: F.concat(F.lit("<"), group(p), F.lit(">"))),
        (rf"\(<?({iri})>?\)", lambda p: F.concat(F.lit("<"), group(p), F.lit(">"))),
        (rf"(?m)^({curie})", group),
        (rf"\(({curie})\)", group),
        (rf"\(<?({iri})>? <?({iri})>?\)",
         lambda p: F.concat(F.lit("<"), group(p), F.lit("> <"), group(p, 2), F.lit(">"))),
        (rf"\(({curie}) <?({iri})>?\)",
         lambda p: F.concat(group(p), F.lit(" <"), group(p, 2), F.lit(">"))),
        (rf"\(({curie}) ({curie})\)",
         lambda p: F.concat(group(p), F.lit(" "), group(p, 2))),
        (r"(?m)^(<urn:[^>]+>)$", lambda p: title),
        (r"\((<urn:[^>]+>)\)", group),
    ]
    out = F.lit(None).cast("string")
    for pattern, build in reversed(shapes):
        out = F.when(title.rlike(pattern), build(pattern)).otherwise(out)
    return out


def heading_label(title: Column, uri: Column) -> Column:
    """Text before the last parenthesis, else the identifier."""
    label = F.regexp_extract(title, r"(.+) \(.*\)", 1)
    return F.when(label != "", label).otherwise(uri)

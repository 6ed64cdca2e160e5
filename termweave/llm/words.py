"""Column functions over the words of a text."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case, so that case and punctuation do not count."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to a value that is computed once. A plain column inside a lambda may be
    replaced by its expression when plans are merged, and then runs again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(items: Column, size: int) -> Column:
    """A hash for each run of `size` items; fewer items give none."""
    def runs(x: Column) -> Column:
        last = F.size(x) - size
        made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                           lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(size)]))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(items, lambda w: F.xxhash64(w)), runs)

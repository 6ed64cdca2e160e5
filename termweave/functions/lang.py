"""Choice of one value among language variants, as an aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNTAGGED = ":untagged"


def effective_preferences(prefs: list[str] | None) -> list[str]:
    if not prefs:
        return [UNTAGGED, "en"]
    return list(prefs) if UNTAGGED in prefs else [*prefs, UNTAGGED]


def language_rank(lang: Column, prefs: list[str] | None = None) -> Column:
    """Place of a tag in the preference list; tags outside it come last."""
    order = effective_preferences(prefs)
    tag = F.lower(F.coalesce(lang, F.lit("")))
    rank = F.lit(len(order))
    for place, pref in reversed(list(enumerate(order))):
        rank = F.when(tag == ("" if pref == UNTAGGED else pref.lower()), F.lit(place)).otherwise(rank)
    return rank


def language_key(lang: Column, order: Column, prefs: list[str] | None = None) -> Column:
    """Sort key of the winner: preference, then for other tags the raw tag, then order.

    A lone row wins whatever its tag, because it is the minimum of its group.
    """
    rank = language_rank(lang, prefs)
    spare = F.when(rank == len(effective_preferences(prefs)), F.coalesce(lang, F.lit(""))).otherwise("")
    return F.struct(rank.alias("rank"), spare.alias("spare"), order.alias("order"))


def pick_by_language(value: Column, lang: Column, order: Column,
                     prefs: list[str] | None = None) -> Column:
    """Aggregate: the value of the preferred language. Combines map-side."""
    return F.min_by(value, language_key(lang, order, prefs))

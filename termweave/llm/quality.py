"""Quality rules whose limits adapt to the language and source of a document.

Native: DataFrame functions only. Limits come from mergeable quantile sketches: a value is
counted in the logarithmic bucket that holds it, so a sketch is a small table of counts,
sketches of parts of a group merge by adding counts, and a quantile read from a merged sketch
is within `ACCURACY` (relative) of the true one whatever the order of the merges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.tables import written
from termweave.llm.words import let, words

SYMBOLS = "#*$%&|<>"
WORD_CHAR = r"[^\x20\x09-\x0D]"
WINDOW = 5
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)

# Measures that are judged.
MEASURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share")
FENCE = 4.0
OUTER = 0.99
LEAST_GROUP = 50


def measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, word counts and the base verdict.

    A word is a run of characters other than ASCII white space; NULL and empty texts have none
    and fail the base rule. Windows of five words are compared by a 64-bit hash within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), F.col("source"),
        words(F.col("text")).alias("_w"),
        (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR)).alias("_l"))
    # Each step is a projection of its own, whose columns the next one reads several times, so
    # that arrays are made once per row and not once per element.
    rows = (rows.withColumn("n_words", F.size("_w").cast("long"))
            .withColumn("word_chars", F.length(F.concat_ws("", "_w")).cast("long"))
            .withColumn("n_lines", F.size("_l").cast("long"))
            .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
            .withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w", "_l"))
    last = F.size("_x") - WINDOW
    rows = rows.withColumn("_h", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("_x"), i + k) for k in range(WINDOW)])))).drop("_x")
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("_p", F.when(twice, _repeated(F.col("_h")))).drop("_h")
    covered = let(F.col("_p"), lambda p: F.aggregate(
        F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _repeated(hashes: Column) -> Column:
    """The places of hashes that occur twice or more, in order: sorted, equal ones are neighbours."""
    def twins(s: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.array_sort(F.transform(let(F.array_sort(pairs), twins), lambda x: x["i"]))


def _shares() -> dict[str, Column]:
    per = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"mean_word": F.col("word_chars") / per, "symbol_share": F.col("n_symbols") / per,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeat_share": F.col("n_repeat_words") / per}


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, measure and bucket, the number of rows; counted in every task before rows meet."""
    value = F.col("value")
    bucket = F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).otherwise(F.lit(-100000)).cast("int")
    long = rows.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("measure"), c.alias("value")) for n, c in _shares().items()])))
    return long.select(*keys, "measure", bucket.alias("bucket")).groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups merged to `keys`."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Per key and measure: rows and one column for each wanted quantile. The window runs over
    the buckets of one sketch, of which there are at most a few thousand."""
    order = Window.partitionBy(*keys, "measure").orderBy("bucket")
    ranked = sketches.withColumn("upto", F.sum("n").over(order)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys, "measure")))
    middle = F.when(F.col("bucket") == -100000, F.lit(0.0)).otherwise(
        F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) * F.lit(2 / (1 + GAMMA)))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        *[F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), middle)).alias(n) for n, q in at.items()])


def _units() -> dict[str, Column]:
    """What a single symbol, line or repeated window adds to a document's value. The mean length
    of words has no such unit."""
    per = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"mean_word": F.lit(0.0), "symbol_share": 1 / per,
            "dup_line_share": 1 / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"), "repeat_share": 2 * WINDOW / per}


def limits(rows: DataFrame, fence: float = FENCE, least: int = LEAST_GROUP) -> DataFrame:
    """Per (lang, source): the least and greatest accepted value of every measure.

    They lie `fence` times the distance of the quartiles below and above the median; that distance
    is at least the error with which the sketch tells it. Outer quantiles would lie among the
    documents to be found where these are more than a few hundredths. Documents that fail the base
    rule are not counted; it has taken out what repeats itself most, so the limit of repeat_share
    may be the quantile at `OUTER`. Groups of fewer than `least` documents take the limits of their language
    over all sources, and languages of fewer than `least` those of all documents.
    """
    fine = written(sketch(rows.where("not base_failed"), ["lang", "source"]))
    at = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "outer": OUTER}
    own = quantiles(fine, ["lang", "source"], at)
    lang = quantiles(merge(fine, ["lang"]), ["lang"], at)
    whole = quantiles(merge(fine, []), [], at)
    level = lambda frame, n: frame.select(*[c for c in ("lang", "source", "measure") if c in frame.columns],
                                          F.struct("total", "q1", "q2", "q3", "outer").alias(n))
    same_lang = F.col("l.lang").eqNullSafe(F.col("o.lang")) & (F.col("l.measure") == F.col("o.measure"))
    chosen = (level(own, "own").alias("o").join(level(lang, "by_lang").alias("l"), same_lang)
              .select("o.lang", "o.source", "o.measure", "own", "by_lang")
              .join(level(whole, "by_all"), "measure"))
    pick = (F.when(F.col("own.total") >= least, F.col("own"))
            .when(F.col("by_lang.total") >= least, F.col("by_lang")).otherwise(F.col("by_all")))
    width = F.greatest(F.col("q.q3") - F.col("q.q1"), 2 * ACCURACY * F.col("q.q2")) * fence
    high = F.col("q.q2") + width
    high = F.when(F.col("measure") == "repeat_share", F.greatest(high, F.col("q.outer"))).otherwise(high)
    bounds = chosen.select("lang", "source", "measure", pick.alias("q")).select(
        "lang", "source", "measure", (F.col("q.q2") - width).alias("low"), high.alias("high"))
    return bounds.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")])


def quality_filter(docs: DataFrame, fence: float = FENCE, least: int = LEAST_GROUP) -> DataFrame:
    """Every document with its measures, `base_failed`, `outside` and `kept`.

    `outside` names the measures that lie outside the limits of the document's (lang, source) by
    more than a single symbol, line or repeated window. Kept is false if the base rule fails or
    there are any. A NULL language or source is a group of its own. Repeated rows
    each get a row. An empty table gives no rows. Other columns are not returned.
    """
    if not {"lang", "source"} <= set(docs.columns):
        raise ValueError("documents need the columns lang and source")
    rows = written(measures(docs))
    bounds = limits(rows, fence, least)
    joined = rows.alias("r").join(
        bounds.alias("b"),
        F.col("r.lang").eqNullSafe(F.col("b.lang")) & F.col("r.source").eqNullSafe(F.col("b.source")), "left")
    share, unit = _shares(), _units()
    outside = F.array_compact(F.array(*[
        F.when(~share[m].between(F.col(f"b.{m}_low") - unit[m], F.col(f"b.{m}_high") + unit[m]), F.lit(m)) for m in MEASURES]))
    kept = ~F.col("base_failed") & (F.size(outside) == 0)
    return joined.select(*[F.col(f"r.`{c}`") for c in rows.columns], outside.alias("outside"), kept.alias("kept"))

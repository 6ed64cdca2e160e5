"""Records of delimited text whose quoted fields may hold line breaks, from lines in many tasks.

Whether a line ends inside a quoted field depends on where it begins. So a line is a function on
two states, outside and inside: it keeps the state, sets it, or flips it. The state before each
line then follows from a running count of the flips and the latest line that sets it; neither
needs the lines of a file in one task. Only files with a line that opens a field are looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.plans.cut import cut
from termweave.plans.ordered import carry_forward, running_sum

# What stands between quotes: no quote but doubled ones.
INNER = r'[^"]*+(?:""[^"]*+)*+'


def _shapes(sep: str) -> tuple[str, str]:
    """A field with its separator, and the plain characters of a field."""
    mark = re.escape(sep)
    plain = rf"[^{mark}]*+"
    return rf'(?:[ ]*+"{INNER}"{plain}|(?![ ]*+"){plain}){mark}', plain


def split_delimited(text: Column, sep: str) -> Column:
    """Fields of one record; a field in quotes may hold separators, doubled quotes, line breaks."""
    mark = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(rf'(?s){mark}[ ]*("{INNER}"|[^{mark}]*)'), F.lit(1))
    return F.transform(raw, lambda f: F.when(
        f.rlike(r'(?s)\A".*"\z') & (F.length(f) > 1),
        F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def _ends_inside(text: Column, sep: str) -> Column:
    """Whether a line that begins outside quotes ends inside."""
    field, _plain = _shapes(sep)
    return F.contains(text, F.lit('"')) & text.rlike(rf'(?s)\A(?:{field})*+[ ]*+"{INNER}\z')


def _marked(lines: DataFrame, sep: str) -> DataFrame:
    """With `from_out` and `from_in`: does the line end inside, begun outside or inside?"""
    _field, plain = _shapes(sep)
    closing = rf'(?s)\A{INNER}"{plain}'
    rest = F.regexp_replace("text", closing, "")
    closes = F.col("text").rlike(closing)
    mark = F.length(F.lit(sep))
    return lines.withColumns({
        "from_out": _ends_inside(F.col("text"), sep),
        "from_in": F.when(~closes, True).when(rest == "", False).otherwise(
            _ends_inside(F.substring(rest, mark + 1, F.length(rest)), sep))})


def delimited_records(lines: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """Records (doc, ord, text) of lines (doc, ord, text), and (doc, ord) of those never closed.

    `ord` is that of the record's first line. A quoted field that is not closed by the end of its
    file takes all that follows with it: it is no record, but a row of the second table.
    """
    open_docs = cut(lines.where(_ends_inside(F.col("text"), sep)).select("doc").distinct())
    if open_docs.isEmpty():
        return lines.select("doc", "ord", "text"), lines.select("doc", "ord").limit(0)
    single = lines.join(open_docs, "doc", "left_anti").select("doc", "ord", "text")
    several = _marked(lines.join(open_docs, "doc", "left_semi").select("doc", "ord", "text"), sep)
    flips = F.col("from_out") & ~F.col("from_in")
    sets = F.col("from_out") == F.col("from_in")
    counted = running_sum(several.withColumn("sets", sets), ["doc"], "ord", flips.cast("int"), "flips")
    odd = F.col("flips") % 2 == 1
    # The state after a line: what the latest setting line set, flipped as often as lines did since.
    held = carry_forward(counted, ["doc"], "ord", {"base": F.when(F.col("sets"), F.col("from_out") != odd)})
    ended = held.withColumn("inside", F.coalesce("base", F.lit(False)) != odd)
    closed = (~F.col("inside")).cast("int")
    numbered = running_sum(ended, ["doc"], "ord", closed, "_upto").withColumn("record", F.col("_upto") - closed)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    whole = numbered.groupBy("doc", "record").agg(F.min("ord").alias("ord"), F.bool_or(~F.col("inside")).alias("closed"))
    unclosed = cut(whole.where(~F.col("closed")).select("doc", "record", "ord"))
    records = numbered.join(unclosed.select("doc", "record"), ["doc", "record"], "left_anti").groupBy("doc", "record").agg(
        F.min("ord").alias("ord"), joined.alias("text"))
    return single.unionByName(records.select("doc", "ord", "text")), unclosed.select("doc", "ord")

"""New identifiers for whole tables of labels, free of collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions import ident as I
from termweave.functions.text import slug
from termweave.plans.cut import cut
from termweave.plans.ordered import running_number, running_sum

# Leading letter per kind.
TYPE_LETTERS = {"class": "C", "annotation-property": "A", "object-property": "R",
                "data-property": "D", "individual": "X", "datatype": "T"}
# Fixed value: place of a character is its checksum value (base 32, then a-z, then I L O U).
CHECK_VALUES = K.BASE32 + "abcdefghijklmnopqrstuvwxyz" + "ILOU"
EPOCH = "2020-01-01"
SPACE = 1 << 20  # names of four drawn characters
DAYS = 1 << 20  # days that four characters can tell
STEP = 648_391  # odd, so that multiples of it run through all of the space


def mint_slug(labels: DataFrame, prefix: str, existing: DataFrame) -> DataFrame:
    """(ord, id) for labels (ord, label): slug, or slug-N with the smallest free N from 2.

    A name that is some label's own slug belongs to the first such label; further labels
    of that slug take numbers in order, skipping existing names and other labels' slugs.
    The r-th free number is r + 1 plus the taken numbers below it, and taken number i has
    `taken - 1 - i` free numbers below, so one running count over both answers all rows,
    and a slug of a third of all labels is still many tasks.
    """
    rows = labels.select("ord", slug(F.col("label")).alias("slug"))
    rows = running_number(rows, ["slug"], "ord", "rank")
    known = existing.where(I.curie_prefix(F.col("id")) == prefix).select(
        I.local_name(F.col("id")).alias("name"))
    in_use = known.select(F.col("name").alias("slug")).distinct().withColumn("_used", F.lit(1))
    rows = rows.join(in_use, "slug", "left").withColumn(
        "extra", F.col("rank") - F.when(F.col("_used").isNotNull(), 0).otherwise(1))
    first = rows.where("extra = 0").select("ord", F.col("slug").alias("name"))
    more = rows.where("extra > 0").select("ord", "slug", "extra")
    shape = r"^(.*)-([1-9][0-9]{0,17})$"
    names = known.union(rows.select("slug")).where(F.col("name").rlike(shape)).distinct()
    taken = names.select(F.regexp_extract("name", shape, 1).alias("slug"),
                         F.regexp_extract("name", shape, 2).try_cast("long").alias("number")).where("number >= 2")
    taken = taken.join(more.select("slug"), "slug", "left_semi")
    taken = running_number(taken, ["slug"], "number", "_i")
    # Both kinds in one order: a label at place r counts taken numbers with fewer than r below.
    # Taken numbers in a row share a place; one row per place stands for them.
    places = taken.groupBy("slug", (F.col("number") - 1 - F.col("_i")).alias("place")).agg(
        F.count(F.lit(1)).alias("t"))
    both = places.withColumn("ord", F.lit(None).cast("long")).unionByName(
        more.select("slug", F.col("extra").alias("place"), F.lit(0).cast("long").alias("t"), "ord"))
    counted = running_sum(both, ["slug"], "place", F.col("t"), "below", ties=["t", "ord"])
    numbered = counted.where("ord IS NOT NULL").select("ord", F.concat(
        "slug", F.lit("-"), (F.col("place") + 1 + F.col("below")).cast("string")).alias("name"))
    return first.unionByName(numbered).select(
        "ord", F.concat(F.lit(prefix + ":"), "name").alias("id"))


def counter_template(template: str) -> tuple[str, int]:
    """`GO_0000000` -> ("GO_", 7)."""
    digits = len(template) - len(template.rstrip("0123456789"))
    if not digits:
        raise ValueError(f"a counter template must end in digits: {template!r}")
    return template[:-digits], digits


def mint_counter(labels: DataFrame, prefix: str, template: str, existing: DataFrame) -> DataFrame:
    """(ord, id): the numbers after the largest existing one, in order."""
    alpha, pad = counter_template(template)
    start = f"{prefix}:{alpha}"
    number = F.substring("id", len(start) + 1, 40)
    last = existing.where(F.startswith("id", F.lit(start)) & number.rlike("^[0-9]+$")).agg(
        F.coalesce(F.max(number.try_cast("long")), F.lit(0).cast("long"))).scalar()
    rows = running_number(labels.select("ord"), [], "ord", "_n").withColumn("_last", last)
    value = (F.col("_n") + F.col("_last")).cast("string")
    padded = F.when(F.length(value) < pad, F.lpad(value, pad, "0")).otherwise(value)
    return rows.select("ord", F.concat(F.lit(start), padded).alias("id"))


def mint_uuid(labels: DataFrame, prefix: str, existing: DataFrame, salt: str = "") -> DataFrame:
    """(ord, id): lower-case UUIDs derived from salt, draw, place and label, so a retry agrees.

    A row whose id exists draws again, so that a second batch of the same labels gets other ids.
    """
    def drawn(rows: DataFrame, draw: int) -> DataFrame:
        h = F.sha2(F.concat_ws("\u001f", F.lit(salt), F.lit(str(draw)), F.col("ord").cast("string"), "label"), 256)
        parts = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
        return rows.withColumn("id", F.concat(F.lit(prefix + ":"), parts[0], F.lit("-"), parts[1], F.lit("-4"), parts[2],
                                              F.lit("-a"), parts[3], F.lit("-"), parts[4]))

    taken = existing.where(I.curie_prefix(F.col("id")) == prefix).select("id")
    rows, done, draw = labels.select("ord", "label"), None, 0
    while True:
        new = cut(drawn(rows, draw))
        won = new.join(taken, "id", "left_anti").select("ord", "id")
        done, draw = won if done is None else done.unionByName(won), draw + 1
        rows = cut(new.join(taken, "id", "left_semi").select("ord", "label"))
        if rows.isEmpty():
            return done


def base32(number: Column, width: int) -> Column:
    """Crockford base 32, padded on the left."""
    plain = F.conv(number.cast("string"), 10, 32)
    return F.lpad(F.translate(plain, "0123456789ABCDEFGHIJKLMNOPQRSTUV", K.BASE32), width, "0")


def _value_of(ch: Column) -> Column:
    return F.when(ch == "", 0).otherwise(
        F.greatest(F.call_function("locate", ch, F.lit(CHECK_VALUES)) - 1, F.lit(0)))


def check_sum(text: Column) -> Column:
    """Sum of character values modulo 32; characters without a value count nothing."""
    total = F.aggregate(F.split(text, ""), F.lit(0), lambda acc, ch: acc + _value_of(ch))
    return F.pmod(total, F.lit(32))


def slug5(label: Column) -> Column:
    letters = F.regexp_replace(F.lower(label), "[^a-z]", "")
    return F.substring(F.concat(letters, F.lit("xxxxx")), 1, 5)


def mint_checked(labels: DataFrame, prefix: str, kind: str, existing: DataFrame, day: Column,
                 salt: str = "", with_slug: bool = False) -> DataFrame:
    """(ord, id): type letter, optional slug, day, four drawn characters, check character.

    Four characters are a million names a day, letter and slug; all of them are given out, and
    what a batch has beyond them takes the names of the days after.
    """
    letter = TYPE_LETTERS.get(kind)
    if letter is None:
        raise ValueError(f"no type letter for kind {kind!r}")
    first_day = F.datediff(day, F.lit(EPOCH).cast("date"))
    taken = existing.where(I.curie_prefix(F.col("id")) == prefix).select("id")
    # Numbers are dealt without replacement: the rows of a slug are numbered, and the numbers
    # run through the space in an order of their own, so only ids that exist make a row draw again.
    slug = slug5(F.col("label")) if with_slug else F.lit("")
    open_ = cut(labels.select("ord", "label", slug.alias("_slug"), F.lit(0).cast("long").alias("_base")))
    done = None
    while not open_.isEmpty():
        placed = running_number(open_, ["_slug"], "ord", "_n", ["label"])
        place = F.col("_base") + F.col("_n") - 1
        draw = F.pmod(place * STEP + F.pmod(F.xxhash64(F.lit(salt), "_slug"), F.lit(SPACE)), F.lit(SPACE))
        days = first_day + F.floor(place / SPACE)
        core = F.concat(F.lit(letter + "_"), F.col("_slug"), base32(days, 4), base32(draw, 4))
        last = F.substring(F.lit(K.BASE32), F.pmod(-check_sum(F.col("_core")), F.lit(32)) + 1, F.lit(1))
        drawn = cut(placed.withColumn("_days", days).withColumn("_core", core).withColumn(
            "id", F.concat(F.lit(prefix + ":"), "_core", last)).drop("_core", "_n"))
        if not drawn.where((F.col("_days") < 0) | (F.col("_days") >= DAYS)).isEmpty():
            raise RuntimeError(f"a day is four characters: from {EPOCH}, {DAYS} days")
        won = drawn.join(taken, "id", "left_anti").select("ord", "id")
        done = won if done is None else done.unionByName(won)
        used = drawn.groupBy("_slug").agg(F.count("*").alias("_used"))
        open_ = cut(drawn.join(taken, "id", "left_semi").join(used, "_slug").select(
            "ord", "label", "_slug", (F.col("_base") + F.col("_used")).alias("_base")))
    return done if done is not None else labels.select("ord", F.lit(None).cast("string").alias("id")).limit(0)


def placeholder_labels(spark, n: int, kind: str | None = None) -> DataFrame:
    stem = f"new-{kind}" if kind else "new-item"
    return spark.range(1, n + 1).select(F.col("id").alias("ord"), F.concat(
        F.lit(stem + "-"), F.col("id").cast("string")).alias("label"))


def mint_batch(labels: DataFrame, scheme: str, prefix: str, existing: DataFrame, **options) -> DataFrame:
    """Ids of a batch under a scheme: slug, counter, uuid or acme."""
    if scheme == "slug":
        return mint_slug(labels, prefix, existing)
    if scheme == "counter":
        return mint_counter(labels, prefix, options.get("template", "0000000"), existing)
    if scheme == "uuid":
        return mint_uuid(labels, prefix, existing, options.get("salt", ""))
    if scheme == "acme":
        return mint_checked(labels, prefix, options.get("kind", "class"), existing,
                            options.get("day", F.current_date()), options.get("salt", ""),
                            options.get("with_slug", False))
    raise ValueError(f"unknown scheme {scheme!r}")


def collisions(minted: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids minted twice or already in use; empty for a sound batch."""
    twice = minted.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    return twice.union(minted.join(existing.select("id"), "id", "left_semi").select("id")).distinct()


def valid_id(ident: Column, scheme: str, prefix: str | None = None, template: str | None = None) -> Column:
    """Whether an id has the shape of a scheme."""
    local = I.local_name(ident)
    curie = F.contains(ident, F.lit(":"))
    if scheme == "uuid":
        ok = local.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    elif scheme == "slug":
        ok = local.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")
    elif scheme == "counter":
        alpha, pad = counter_template(template or "0000000")
        ok = F.startswith(local, F.lit(alpha)) & F.substring(local, len(alpha) + 1, 60).rlike(f"^[0-9]{{{pad},}}$")
        if prefix is not None:
            ok = ok & (I.curie_prefix(ident) == prefix)
    elif scheme == "acme":
        ok = local.rlike("^[A-Z]_(?:[a-z]{5})?[0-9A-HJKMNP-TV-Z]{9}$") & (check_sum(local) == 0)
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return curie & ok


def verify_ids(frame: DataFrame, scheme: str, **options) -> DataFrame:
    return frame.withColumn("valid", valid_id(F.col("id"), scheme, **options))

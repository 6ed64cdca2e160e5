"""Minting queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from catalog.lift_sql import lifted
from termweave.operators import minting as I
from termweave.plans.cut import cut
from termweave.sources import lift


def labels(spark, sf):
    """Part names; every ninth is numbered like a slug, every fiftieth is blank."""
    key = F.col("p_partkey")
    label = (F.when(key % 50 == 0, "  ??").when(key % 9 == 0, F.concat("p_name", F.lit(" "), (key % 4).cast("string")))
             .otherwise(F.initcap("p_name")))
    return lift.read(spark, sf, "part").select(key.alias("ord"), label.alias("label"))


def existing(spark, sf):
    nation = lift.read(spark, sf, "nation")
    n = F.col("n_nationkey").cast("string")
    return nation.select(F.concat(F.lit("ex:red-widget-"), n).alias("id")).union(
        nation.select(F.concat(F.lit("ex:GO_"), F.lpad(n, 7, "0")))).union(
        nation.where("n_nationkey = 0").select(F.lit("ex:small-ring")))


LABELS = """
WITH l AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN '  ??' WHEN p_partkey % 9 = 0 THEN p_name || ' ' || (p_partkey % 4)
    ELSE p_name END AS label FROM part),
ex AS (SELECT 'ex:red-widget-' || n_nationkey AS id FROM nation UNION SELECT 'ex:GO_' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') FROM nation
    UNION SELECT 'ex:small-ring'),
s AS (SELECT ord, CASE WHEN t = '' THEN 'x' ELSE t END AS slug FROM (SELECT ord,
    regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS t FROM l))
"""


@query("mint_slug", LABELS + """
, r AS (SELECT ord, slug, row_number() OVER (PARTITION BY slug ORDER BY ord)
    - CASE WHEN 'ex:' || slug IN (SELECT id FROM ex) THEN 0 ELSE 1 END AS extra FROM s),
taken AS (SELECT substr(id, 4) AS name FROM ex UNION SELECT slug FROM s),
free AS (SELECT slug, n, row_number() OVER (PARTITION BY slug ORDER BY n) AS k FROM (
    SELECT slug, unnest(generate_series(2, m + 40)) AS n FROM (SELECT slug, max(extra) AS m FROM r GROUP BY slug))
  WHERE slug || '-' || n NOT IN (SELECT name FROM taken))
SELECT ord, 'ex:' || r.slug || CASE WHEN extra = 0 THEN '' ELSE '-' || f.n END AS id
FROM r LEFT JOIN free f ON f.slug = r.slug AND f.k = extra""")
def mint_slug(spark, sf):
    return I.mint_slug(labels(spark, sf), "ex", existing(spark, sf))


@query("mint_counter", LABELS + """
SELECT ord, 'ex:GO_' || lpad(CAST(24 + row_number() OVER (ORDER BY ord) AS VARCHAR), 7, '0') AS id FROM l""")
def mint_counter(spark, sf):
    return I.mint_counter(labels(spark, sf), "ex", "GO_0000000", existing(spark, sf))


def first_uuids(spark, sf):
    """Ids of an earlier batch, of every third part."""
    rows = labels(spark, sf)
    return I.mint_uuid(rows.where("ord % 3 = 0"), "ex", existing(spark, sf), "batch")


@query("mint_uuid", LABELS + """
, raw AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN '  ??' WHEN p_partkey % 9 = 0 THEN p_name || ' ' || (p_partkey % 4)
    ELSE list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') END AS label FROM part),
h AS (SELECT ord, sha256('batch' || chr(31) || CASE WHEN ord % 3 = 0 THEN '1' ELSE '0' END || chr(31) || ord || chr(31) || label) AS h FROM raw)
SELECT ord, 'ex:' || h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] AS id FROM h""")
def mint_uuid(spark, sf):
    """A third of the labels had ids before and draw again."""
    return I.mint_uuid(labels(spark, sf), "ex", existing(spark, sf).union(first_uuids(spark, sf).select("id")), "batch")


def checked(spark, sf):
    line = lift.remarks(spark, sf).select(F.col("doc").alias("ord"), F.col("text").alias("label"))
    return I.mint_checked(line.dropDuplicates(["ord"]), "ex", "individual", existing(spark, sf),
                          F.lit("2024-05-17").cast("date"))


@query("mint_checked")
def mint_checked(spark, sf):
    return checked(spark, sf)


SCHEMES = {"slug": {}, "counter": {"template": "GO_0000000"}, "uuid": {},
           "acme": {"kind": "class", "with_slug": True}}


@query("mint_batch_collisions", f"""
SELECT scheme, 2 * count(*) AS n, 2 * count(*) AS distinct_ids, CAST(0 AS BIGINT) AS collisions
FROM part, (VALUES {", ".join(f"('{s}')" for s in SCHEMES)}) v(scheme) GROUP BY scheme""")
def mint_batch_collisions(spark, sf):
    """Two batches of the same labels under each scheme: no id is given twice or was in use."""
    rows, known = labels(spark, sf), existing(spark, sf)
    out = []
    day = F.lit("2024-05-17").cast("date")
    for scheme, options in SCHEMES.items():
        options = options | {"day": day}
        first = cut(I.mint_batch(rows, scheme, "ex", known, **options).select("id"))
        both = first.union(I.mint_batch(rows, scheme, "ex", known.union(first), **options).select("id"))
        counts = both.agg(F.count("*").alias("n"), F.countDistinct("id").alias("distinct_ids"))
        clashes = I.collisions(both, known).agg(F.count("*").alias("collisions"))
        out.append(counts.crossJoin(clashes).select(F.lit(scheme).alias("scheme"), "n", "distinct_ids", "collisions"))
    return reduce(DataFrame.unionByName, out)


ALPH = "0123456789ABCDEFGHJKMNPQRSTVWXYZabcdefghijklmnopqrstuvwxyzILOU"


@query("verify_ids", """
WITH i AS (SELECT o_orderkey AS k, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS h FROM orders),
ids AS (SELECT k, 'ex:C_' || upper(translate(lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || h, 'ilou', 'xxxx')) || substr('""" + ALPH + """', k % 32 + 1, 1) AS id FROM i
  UNION ALL SELECT k, 'ex:GO_' || k FROM i UNION ALL SELECT k, 'ex:Some-' || k FROM i UNION ALL SELECT k, 'ex:some-' || k FROM i)
SELECT id, regexp_matches(id, '^[^:]*:[A-Z]_([a-z]{5})?[0-9A-HJKMNP-TV-Z]{9}$') AND list_sum(list_transform(string_split(substr(id, 4), ''),
    lambda c: greatest(instr('""" + ALPH + """', c) - 1, 0))) % 32 = 0 AS acme,
  regexp_matches(id, '^ex:GO_[0-9]{4,}$') AS counter, regexp_matches(id, '^[^:]*:[a-z0-9]+(-[a-z0-9]+)*$') AS slug,
  false AS uuid FROM ids""")
def verify_ids(spark, sf):
    k = F.col("o_orderkey")
    digits = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.substring(F.md5(k.cast("string")), 1, 4))
    acme = F.concat(F.lit("ex:C_"), F.upper(F.translate(digits, "ilou", "xxxx")),
                    F.substring(F.lit(ALPH), (k % 32 + 1).cast("int"), F.lit(1)))
    rows = lift.read(spark, sf, "orders").select(F.explode(F.array(
        acme, F.concat(F.lit("ex:GO_"), k.cast("string")), F.concat(F.lit("ex:Some-"), k.cast("string")),
        F.concat(F.lit("ex:some-"), k.cast("string")))).alias("id"))
    return rows.select("id", I.valid_id(F.col("id"), "acme").alias("acme"),
                       I.valid_id(F.col("id"), "counter", "ex", "GO_0000").alias("counter"),
                       I.valid_id(F.col("id"), "slug").alias("slug"), I.valid_id(F.col("id"), "uuid").alias("uuid"))


@query("verify_minted", "SELECT 'acme' AS scheme, count(DISTINCT (l_orderkey * 10 + l_linenumber) * 10000000 + l_suppkey) AS n, true AS valid FROM lineitem "
       "UNION ALL SELECT 'uuid', count(*), true FROM part")
def verify_minted(spark, sf):
    """What is minted verifies."""
    a = I.verify_ids(checked(spark, sf), "acme").select(F.lit("acme").alias("scheme"), "valid", "id")
    u = I.verify_ids(I.mint_uuid(labels(spark, sf), "ex", existing(spark, sf)), "uuid").select(F.lit("uuid").alias("scheme"), "valid", "id")
    return a.union(u).groupBy("scheme").agg(F.countDistinct("id").alias("n"), F.bool_and("valid").alias("valid"))

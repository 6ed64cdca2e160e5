"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import (centroids, decontamination, hidden_markov, keyed_ids, language, lines, packing, personal,
                           quality, simhash, spelling, urls, warc)
from termweave.llm.tables import new_path, table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base, as is the digest; n_added counts what the tagger added."""
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in personal.KINDS])
    line = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{name}")  # noqa: B023
              for k, name in enumerate(personal.KINDS)]
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("all")).alias("spans"),
                        (F.size("all") - F.size("base")).cast("long").alias("n_added"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of words that are deleted; documents without any do not appear."""
    return lines.repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "start", "words")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = keyed_ids.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), new_path(spark, "ids"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_packing, op2_quality_rules, op3_simhash, op4_warc, op5_personal_data, op6_decontamination, op7_language_id,
    op8_hidden_markov, op9_line_dedup, op10_url_filter, op11_centroids, op12_spelling, op13_token_ids, pipeline)}



def _centroid_sql(k: int = 40, rounds: int = 5, dimension: int = 64) -> str:
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, sha256('2:' || vec_id) AS h,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM k ORDER BY h LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(k.v) AS v, min({{'d': list_inner_product(k.v, k.v)
  - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), 'c': c.c}}) AS m FROM k, c{r} AS c GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS v FROM (
  SELECT m.c AS c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dimension + 1}) t(j) GROUP BY 1, 2) GROUP BY c
  UNION ALL SELECT c, v FROM c{r} WHERE c NOT IN (SELECT m.c FROM a{r}))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON c.c = m.c"""


ORACLES: dict[str, str] = {
    "op11_centroids": _centroid_sql(),
    "op4_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < origin THEN origin END AS refers_to FROM q""",
    "op9_line_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS start FROM w),
k AS (SELECT doc_id, start, md5(array_to_string(w[start + 1:start + 50], ' ')) AS h FROM s),
f AS (SELECT doc_id, start, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS place FROM k),
r AS (SELECT doc_id, start, start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS gap FROM f WHERE place > 1),
g AS (SELECT doc_id, start, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM r)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(start) - min(start) + 50 AS BIGINT) AS words
FROM g GROUP BY doc_id, run""",
}

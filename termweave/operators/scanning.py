"""Identifiers in running text: finding them, labelling them, counting them."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave import constants as K
from termweave.functions import ident as I
from termweave.functions.pieces import occurrences
from termweave.model import ActiveSources, Index
from termweave.operators.identifiers import contract_best
from termweave.operators.lookup import all_active_ids, resolve_labels
from termweave.plans.cut import cut
from termweave.plans.ordered import top_per_group

# Rare spaces become plain ones first: a class of ASCII characters matches far faster.
_SPACES = dict.fromkeys(map(ord, K.OTHER_SPACES), " ")
_PASSES = [("angle-iri", re.compile(K.ANGLE_IRI, re.ASCII), 1),
           ("bare-iri", re.compile(K.BARE_IRI, re.ASCII), 0),
           ("curie", re.compile(K.CURIE_TOKEN, re.ASCII), 0)]

# The three passes in one. An IRI starts where no name goes on, as a name stops before an IRI and
# one that runs into it is none; and nothing that starts earlier covers an angle bracket.
# A word that begins no identifier is taken whole, so no search restarts inside it.
_ANGLE = K.ANGLE_IRI.replace("(", "").replace(")", "")
_BARE = K.BARE_IRI + "+"
_IRI_GOES_ON = K.BARE_IRI.removeprefix("h").removesuffix("+")
_RUN = r"[-A-Za-gi-z0-9_./%:]*+"
_NAME = (rf"(?:[A-Za-z][-A-Za-z0-9_.]*+)?+:(?=[A-Za-z_]){_RUN}(?:h(?!{_IRI_GOES_ON}){_RUN})*+"
         rf"(?!h{_IRI_GOES_ON})")
_WORD = r"[-A-Za-z0-9_.]++(?!:(?:[A-Za-z_]|//))"
_KINDS = ["angle-iri", "bare-iri", "curie"]
_ANY = re.compile(f"({_ANGLE})|({_BARE})|({_NAME})|{_WORD}", re.ASCII)


def _spelled(pattern: str) -> str:
    """The pattern with its classes spelled out: the JVM tests single characters in one step, and
    ranges one after the other."""
    for span, every in [(r"\x09-\x0D", r"\x09\x0A\x0B\x0C\x0D"), ("A-Z", string.ascii_uppercase),
                        ("a-gi-z", string.ascii_lowercase.replace("h", "")), ("a-z", string.ascii_lowercase),
                        ("0-9", string.digits)]:
        pattern = pattern.replace(span, every)
    return pattern


def _scan(text: str, max_hits: int) -> list[tuple[str, int, int, str]]:
    """Three passes up to a number of hits; one that overlaps an earlier pass is dropped, not shortened."""
    hits: list[tuple[str, int, int, str]] = []
    text = text.translate(_SPACES)
    taken = bytearray(len(text))
    for kind, pattern, group in _PASSES:
        for m in pattern.finditer(text):
            start, end = m.span()
            if 1 in taken[start:end]:
                continue
            taken[start:end] = b"\x01" * (end - start)
            hits.append((m.group(group), start, end, kind))
            if len(hits) >= max_hits:
                return sorted(hits, key=lambda h: h[1])
    return sorted(hits, key=lambda h: h[1])


def _scan_all(text: str) -> Iterator[tuple[str, int, int, str]]:
    if not text.isascii():
        text = text.translate(_SPACES)
    for m in _ANY.finditer(text):
        if m.lastindex:
            token, (start, end) = m[0], m.span()
            yield token[1:-1] if m.lastindex == 1 else token, start, end, _KINDS[m.lastindex - 1]


def scan_tokens(frame: DataFrame, keys: list[str], text_col: str,
                max_hits: int | None = None) -> DataFrame:
    """(keys, token, start, end, kind) of every identifier, with character offsets."""
    fields = [frame.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("token", T.StringType()),
                           T.StructField("start", T.IntegerType()),
                           T.StructField("end", T.IntegerType()),
                           T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for at, text in enumerate(batch.column(len(keys)).to_pylist()):
                if text:
                    found = list(_scan_all(text) if max_hits is None else _scan(text, max_hits))
                    rows.extend([at] * len(found))
                    hits.extend(found)
            if hits:
                taken = pa.array(rows, pa.int64())
                token, start, end, kind = zip(*hits)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(taken) for i in range(len(keys))], pa.array(token, pa.string()),
                     pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string())],
                    names=schema.fieldNames())

    return frame.select(*keys, text_col).mapInArrow(run, schema)


def extract_ids(frame: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, token, kind): one row per identifier occurrence, found inside the JVM without offsets."""
    text = F.col(text_col)
    text = F.when(F.length(text) == F.octet_length(text), text).otherwise(
        F.translate(text, K.OTHER_SPACES, " " * len(K.OTHER_SPACES)))
    found = F.regexp_extract_all(text, F.lit(_spelled(f"({_ANGLE}|{_BARE}|{_NAME})|{_WORD}")), F.lit(1))
    hits = frame.select(*keys, F.explode(found).alias("token")).where("token <> ''")
    angle, token = F.startswith("token", F.lit("<")), F.col("token")
    kind = F.when(angle, _KINDS[0]).when(token.rlike("^https?://"), _KINDS[1]).otherwise(_KINDS[2])
    return hits.select(*keys, F.when(angle, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token).alias("token"),
                       kind.alias("kind"))


def known_tokens(tokens: DataFrame, index: Index, active: ActiveSources) -> DataFrame:
    """Token rows the index knows under their own or their contracted form.

    The ids grow with the index, so they are not broadcast. Tokens that repeat are better counted
    before than after.
    """
    ids = all_active_ids(index, active, include_curies=True).hint("merge")
    return tokens.join(ids.select(F.col("id").alias("token")), "token", "left_semi")


def label_tokens(tokens: DataFrame, index: Index, active: ActiveSources) -> DataFrame:
    """Token rows with their label; misses keep NULL.

    Labels are resolved once per distinct token. The join back has one row per token on the
    right, so a token that fills a third of all texts splits on the left.
    """
    labels = cut(resolve_labels(tokens, index, active))
    return tokens.join(labels, "token", "left")


def label_texts(texts: DataFrame, keys: list[str], text_col: str, index: Index,
                active: ActiveSources) -> DataFrame:
    """Identifiers of texts with their labels. The tokens are written once, because finding
    the distinct ones and labelling all would scan every text twice."""
    return label_tokens(cut(extract_ids(texts, keys, text_col)), index, active)


def token_stats(tokens: DataFrame, doc_col: str) -> DataFrame:
    """(token, kind, hits, docs)."""
    return tokens.groupBy("token", "kind").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct(doc_col).alias("docs"))


def approx_token_stats(tokens: DataFrame, doc_col: str, rsd: float = 0.05) -> DataFrame:
    return tokens.groupBy("token", "kind").agg(
        F.count(F.lit(1)).alias("hits"), F.approx_count_distinct(doc_col, rsd).alias("docs"))


def unknown_tokens(tokens: DataFrame, index: Index, active: ActiveSources) -> DataFrame:
    """(token, hits) of tokens nobody defines, counted before they are looked up."""
    counts = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("hits")))
    found = resolve_labels(counts, index, active).where("label IS NOT NULL")
    return counts.join(found.select("token"), "token", "left_anti")


def _replaced(text: Column, hits: Column) -> Column:
    """Text with (start, end, new) spans replaced; the spans are sorted and do not overlap."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(
        hits, start,
        lambda acc, h: F.struct(h["end"].alias("pos"), F.concat(
            acc["out"], F.substring(text, acc["pos"] + 1, h["start"] - acc["pos"]), h["new"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def annotate_text(lines: DataFrame, keys: list[str], text_col: str, labels: DataFrame,
                  style: str = "link", skip: Column | None = None) -> DataFrame:
    """Lines with identifiers shown as links to their labels, or as the labels.

    `labels` is (token, label) with one row per token; `skip` marks lines to leave alone
    (headings, code blocks). A line's spans come together again per line.
    """
    skip = F.lit(False) if skip is None else skip
    lines = cut(lines)  # scanned, and joined with what was found
    spans = scan_tokens(lines.where(~skip), keys, text_col)
    shown = (F.concat(F.lit("[[#"), "token", F.lit("]["), "label", F.lit("]]"))
             if style == "link" else F.col("label"))
    hits = spans.join(labels.where("label IS NOT NULL"), "token").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", shown.alias("new")))).alias("_hits"))
    return lines.join(hits, keys, "left").withColumn(
        text_col, F.when(F.col("_hits").isNull(), F.col(text_col)).otherwise(
            _replaced(F.col(text_col), F.col("_hits")))).drop("_hits")


def find_references(ids: DataFrame, parsed: DataFrame, nodes: DataFrame,
                    definitions_only: bool = False) -> DataFrame:
    """(id, doc, ord, heading, context): lines that hold an id as a whole token.

    A reference is shown under its heading; a definition is the heading line itself.
    """
    rows = parsed.where("is_heading") if definitions_only else parsed
    wanted = ids.select("id").distinct()
    # Texts are cut up with their place alone; the few lines that hold an id are joined back.
    hits = occurrences(rows, ["doc", "ord"], "text", wanted).select("id", "doc", "ord").distinct()
    hits = hits.join(rows.select("doc", "ord", "node_id", "text", "is_heading"), ["doc", "ord"])
    titles = nodes.select("doc", "node_id", F.col("title").alias("heading"))
    return hits.join(titles, ["doc", "node_id"], "left").select(
        "id", "doc", "ord", "heading", "is_heading", F.trim("text").alias("context"))


def describe(ids: DataFrame, references: DataFrame, max_ref: int = 10) -> DataFrame:
    """(id, defined_in, place, doc, ord, more): definition, first references, the rest counted.

    The first references are found by a rank with a limit, which is applied in every task
    before rows of a popular id meet.
    """
    first = top_per_group(references, ["id"], ["doc", "ord"], max_ref, "place").select(
        "id", "place", "doc", "ord")
    counts = references.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("doc", F.when(F.col("is_heading"), F.struct("doc", "ord"))).alias("defined_in"))
    return (ids.select("id").distinct().join(counts, "id", "left").join(first, "id", "left")
            .select("id", "defined_in", "place", "doc", "ord",
                    F.greatest(F.coalesce("_n", F.lit(0)) - max_ref, F.lit(0)).cast("long").alias("more")))


# Names an axiom parser knows by itself.
KEEP_AS_IS = ["owl:Thing", "owl:Nothing", "owl:topObjectProperty", "owl:bottomObjectProperty",
              "owl:topDataProperty", "owl:bottomDataProperty", "rdfs:Literal"]
_AXIOM_TOKEN = r"<[^>\s]+>|[A-Za-z_][-A-Za-z0-9_.]*:[A-Za-z0-9_][-A-Za-z0-9_.]*"


def quoted_label(label: Column) -> Column:
    """Label as one axiom token: single quotes where it holds spaces or brackets."""
    return F.when(label.rlike(r"""[\[\] \t"'\\(){},]"""),
                  F.concat(F.lit("'"), F.replace(label, F.lit("'"), F.lit("\\'")), F.lit("'"))
                  ).otherwise(label)


# Fixed value: parts into which the rows of one name are dealt.
NAME_PARTS = 8


def dealt_names(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces with (_key, _part) to join on: a name that most axioms hold is dealt in parts, and what
    is no name goes anywhere (no name begins with a space)."""
    anywhere = F.concat(F.lit(" "), F.pmod(F.xxhash64(*keys, "_at"), F.lit(4096)).cast("string"))
    return pieces.withColumns({"_key": F.coalesce("_name", anywhere),
                               "_part": F.pmod(F.xxhash64(*keys), F.lit(NAME_PARTS)).cast("int")})


def axiom_to_labels(axioms: DataFrame, keys: list[str], value_col: str, labels: DataFrame,
                    table: DataFrame) -> DataFrame:
    """Axioms with identifiers replaced by labels: (keys, value, substitutions).

    `labels` is (id, label), `table` (prefix, expansion). Unknown names stay as they are.
    """
    split = rf"({_AXIOM_TOKEN}|(?:(?!{_AXIOM_TOKEN}).)+)"
    parts = F.regexp_extract_all(F.col(value_col), F.lit(f"(?s){split}"), F.lit(1))
    pieces = axioms.select(*keys, F.posexplode(parts).alias("_at", "_piece"))
    name = F.when(F.col("_piece").rlike(f"^(?:{_AXIOM_TOKEN})$")
                  & ~F.col("_piece").isin(KEEP_AS_IS), I.strip_brackets(F.col("_piece")))
    pieces = pieces.withColumn("_name", name)
    names = pieces.where("_name IS NOT NULL").select("_name").distinct()
    short = contract_best(names, "_name", table)
    known = names.join(short, F.col("_name") == F.col("iri"), "left").select(
        "_name", F.coalesce("curie", "_name").alias("id"))
    found = known.join(labels.where("coalesce(label, '') <> ''"), "id").select(
        "_name", quoted_label(F.col("label")).alias("_new"))
    found = found.select(F.col("_name").alias("_key"), "_new", F.explode(F.sequence(F.lit(0), F.lit(NAME_PARTS - 1))).alias("_part"))
    shown = dealt_names(pieces, keys).join(found.hint("merge"), ["_key", "_part"], "left")
    return shown.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("_at", F.coalesce("_new", "_piece").alias("t")))), lambda e: e["t"]), "")
        .alias("value"), F.count("_new").alias("substitutions"))

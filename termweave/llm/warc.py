"""WARC archives with revisit records.

An archive is written by Spark's text sink: every row is a record, and the line separator is the
CRLF CRLF that ends one. Files are committed by Spark, so a lost executor leaves no half file
behind, and may lie in any store Spark can write. They are compressed as a whole, so each
is read back by one task in order; parsing goes by Content-Length over the stream of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.tables import new_path

END = "\r\n\r\n"
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 20_000


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html (NULL: empty) with payload_bytes and payload_digest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))


def resolve(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds record_type and refers_to. Only headers meet by payload digest: per digest the
    largest page_id, taken in every task first; digests of one record drop out there."""
    heads = records.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = (heads.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
             .where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first"))
    joined = records.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & (F.col("page_id") < F.col("_first"))
    return joined.select(*[F.col(f"`{c}`") for c in records.columns],
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("_first")).alias("refers_to"))


def _urn(page: Column) -> Column:
    """A record id that follows from the page id."""
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(records: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One string column: a whole record with fresh headers, up to where its closing CRLF CRLF
    begins. A revisit holds the HTTP headers only. Characters of a URL that could end a header
    line are percent-encoded."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    fields = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        line("Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")))
    return records.select(F.concat(fields, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write a record per row of pages, payloads of `least` bytes or more once."""
    rows = record_text(resolve(payloads(pages), least))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parsed(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records from the pieces between separators, in the order of each file."""
    buffer, file = bytearray(), None
    for batch in pieces:
        rows = []
        for name, piece in zip(batch["file"], batch["value"]):
            if name != file:
                if buffer.strip():
                    raise ValueError(f"{file} ends within a record")
                buffer, file = bytearray(), name
            buffer += piece
            buffer += b"\r\n\r\n"
            while True:
                # No record begins with a line end; at the end of a file, where the last piece has
                # no separator after it, the one added above is too many.
                while buffer[:2] == b"\r\n":
                    del buffer[:2]
                at = buffer.find(b"\r\n\r\n")
                if at < 0:
                    break
                head = dict(x.split(b": ", 1) for x in bytes(buffer[:at]).split(b"\r\n")[1:])
                size = int(head[b"Content-Length"])
                if len(buffer) < at + 4 + size + 4:
                    break
                rows.append((head, bytes(buffer[at + 4:at + 4 + size])))
                del buffer[:at + 4 + size + 4]
        text = lambda h, k: h[k].decode() if k in h else None
        out = []
        for head, block in rows:
            http, _, payload = block.partition(b"\r\n\r\n")
            page, kind = text(head, b"Page-Id"), text(head, b"WARC-Type")
            out.append((None if page is None else int(page), text(head, b"WARC-Record-ID"), kind, text(head, b"WARC-Target-URI"),
                        int(http.rsplit(b"Content-Length: ", 1)[1]), text(head, b"WARC-Payload-Digest").removeprefix("sha1:"),
                        text(head, b"WARC-Refers-To"), payload if kind == "response" else None))
        frame = pd.DataFrame(out, columns=["page_id", "record_id", "record_type", "url", "payload_bytes", "payload_digest",
                                           "refers_to_id", "payload"])
        yield frame.astype({"page_id": "Int64"})
    if buffer.strip():
        raise ValueError(f"{file} ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path; payload is NULL in revisits."""
    pieces = spark.read.option("lineSep", END).text(path).select(
        F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    return pieces.mapInPandas(_parsed, "page_id long, record_id string, record_type string, url string, payload_bytes long, "
                                       "payload_digest string, refers_to_id string, payload binary")


def resolved_archives(records: DataFrame) -> DataFrame:
    """Records read back, each revisit joined with the response that holds its payload."""
    heads = records.select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id", F.sha1("payload").alias("held"))
    # A revisit names a record; that record is found by the payload digest both carry.
    origin = heads.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= LEAST_REVISIT)).select(
        F.col("payload_digest").alias("_digest"), F.col("page_id").alias("_page")).groupBy("_digest").agg(F.max("_page").alias("_page"))
    revisit = F.col("record_type") == "revisit"
    named = revisit & (F.col("payload_digest") == F.col("_digest"))
    out = heads.join(origin, named, "left")
    return out.select("page_id", "payload_bytes", F.coalesce("held", "payload_digest").alias("payload_digest"), "record_type",
                      F.when(revisit & (_urn(F.col("_page")) == F.col("refers_to_id")), F.col("_page")).alias("refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read these back, resolve the revisits.

    NULL or empty html is an empty payload. A NULL page_id is neither revisit nor the response
    of one. Rows that repeat the largest page_id of a payload are all responses. An empty table
    gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return resolved_archives(read_archives(spark, path))

"""Revisit resolution for WARC archives: equal payloads are stored once, later records refer to the first.

Headers (page id, payload digest, size) are shuffled by digest without payloads; the smallest page id of each digest
owns the response, the others become revisit records. The decisions are joined to the pages once, in as many
partitions as archives are wanted, and Spark's own writer commits the archives, so lost tasks are repeated safely. A
record is text (UTF-8 payload), and every WARC record ends with two line ends, which is the writer's separator.
Archives are gzip files.

A null html has an empty payload; a null url is written as ``urn:page:<id>``. Repeated rows with the smallest page id
of their payload are all responses. A page without id is never referred to while another page has the payload.
Payloads below ``least_bytes`` are always responses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
LEAST_BYTES = 100
#: Payload bytes of one archive, about.
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """One row per page without its payload column's null: page_id, url, payload, payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), r"[\x00-\x20\x7f]", "%20").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_key"),
    )


def originals(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Digests with several records: the page that keeps the payload."""
    return (
        heads.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("first"), F.count("*").alias("records"))
        .filter("records > 1")
        .select("payload_digest", F.col("first.page_id").alias("first_page_id"), F.col("first.url").alias("first_url"))
    )


def _uuid(*parts: Column) -> Column:
    """A record id that a repeated task writes again."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record_id(page_key: Column, digest: Column) -> Column:
    return _uuid(page_key, digest)


def records(pages: DataFrame, date: str, archives: int, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One column ``record``: the whole WARC record of each page without its closing line ends."""
    heads = headers(pages)
    firsts = originals(heads, least_bytes)
    keys = heads.select("page_key", "payload_digest", "page_id").distinct()
    revisits = keys.join(firsts, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("first_page_id")))
    revisits = revisits.drop("page_id").repartition(archives, "page_key", "payload_digest")
    # payloads move once, straight into the archives' partitions
    rows = heads.repartition(archives, "page_key", "payload_digest").join(
        revisits, ["page_key", "payload_digest"], "left")
    again = F.col("first_url").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    none = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_key"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", digest),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", _record_id(F.coalesce(F.col("first_page_id").cast("string"), none), F.col("payload_digest"))),
            line("WARC-Refers-To-Target-URI", F.col("first_url")),
        )).otherwise(none),
        line("X-Page-ID", F.col("page_key")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END))
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
                   least_bytes: int = LEAST_BYTES) -> None:
    total = pages.agg(F.sum(F.octet_length("html").cast("long")).alias("n")).first()["n"] or 0
    archives = max(1, -(-total // archive_bytes))
    records(pages, date, archives, least_bytes).write.option(
        "lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield fields, data[start:stop]
        at = stop + len(RECORD_END)


SCHEMA = ("record_id string, page_id long, record_type string, refers_to_id string, payload_digest string, "
          "payload_bytes long")


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import gzip
    import hashlib

    for batch in batches:
        for content in batch["content"]:
            out = []
            for h, block in parse(gzip.decompress(content)):
                payload = block[block.index(b"\r\n\r\n") + 4:]
                response = h["WARC-Type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if response else None
                if response and f"sha256:{digest}" != h["WARC-Payload-Digest"]:
                    raise ValueError(f"damaged payload of {h['WARC-Record-ID']}")
                out.append((
                    h["WARC-Record-ID"], int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Type"],
                    h.get("WARC-Refers-To"), digest, len(payload) if response else None))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives; revisits are still unresolved."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_parsed, SCHEMA)


def resolve(found: DataFrame) -> DataFrame:
    """Revisit records get the payload facts of the response they refer to; responses are not shuffled for it."""
    responses = found.filter("record_type = 'response'")
    facts = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kept = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.min("page_id").alias("refers_to"), F.first("payload_digest").alias("of_digest"),
        F.first("payload_bytes").alias("of_bytes"))
    again = found.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id").join(
        kept, "refers_to_id", "left")
    again = again.withColumnsRenamed({"of_digest": "payload_digest", "of_bytes": "payload_bytes"}).select(*facts)
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*facts).unionByName(again)


def deduplicate(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolve(stored(read_archives(pages.sparkSession, path), "records"))

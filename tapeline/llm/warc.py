"""WARC archives: write records in segments with chunked HTTP bodies, read and reassemble them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import shared_dir, written

#: Characters of a chunk of the HTTP body and of a segment's block.
CHUNK, SEGMENT = 4096, 16384
#: Characters of payloads whose records are made at once.
CHARS = 4_000_000
#: Payloads with fewer bytes are never written as revisits.
MIN_REVISIT = 100
#: A record's first line; no block holds it, since chunks end inside it. No part of it starts it anew, so readers can't lose their place.
MARK = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PAGE = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: str) -> str:
    """The body in chunked transfer framing. A chunk ends inside each ``WARC/1.1``, so that no block holds a record's first line."""
    out = []
    for at in range(0, len(body), CHUNK):
        pieces = body[at : at + CHUNK].split("WARC/")
        for k, piece in enumerate(pieces):
            piece += "WARC/" * (k < len(pieces) - 1)
            if piece:
                out.append(f"{len(piece.encode()):x}\r\n{piece}\r\n")
    return "".join(out) + "0\r\n\r\n"


def dechunked(block: bytes) -> bytes:
    """The body of chunked framing; ValueError if it is broken."""
    at, out = 0, []
    while True:
        end = block.index(b"\r\n", at)
        size = int(block[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(block[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or block[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += 2


def _record(kind: str, ident: str, block: str, more: dict[str, str]) -> str:
    fields = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": "2024-01-01T00:00:00Z", **more, "Content-Length": str(len(block.encode()))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}\r\n{block}\r\n\r"  # the writer adds the last \n


def records(page: str, digest: str, origin: str | None, body: str, number: str) -> Iterator[str]:
    """The records of a page: a revisit, or a response in as many segments as it takes. ``number`` is the archive's own for the row."""
    ident = f"<urn:record:{number}>"
    common = {"WARC-Target-URI": PAGE + page, "WARC-Payload-Digest": f"sha256:{digest}"}
    if origin is not None and origin != page:
        yield _record("revisit", ident, "", common | {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": PAGE + origin})
        return
    block = HTTP + chunked(body)
    parts = [block[at : at + SEGMENT] for at in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield _record("response", ident, block, common | {"Content-Type": "application/http;msgtype=response"})
        return
    for k, part in enumerate(parts, 1):
        more = {"WARC-Segment-Number": str(k)}
        if k == 1:
            yield _record("response", ident, part, common | more | {"Content-Type": "application/http;msgtype=response"})
        else:
            more["WARC-Segment-Origin-ID"] = ident
            if k == len(parts):
                more["WARC-Segment-Total-Length"] = str(len(block.encode()))
            yield _record("continuation", f"{ident[:-1]}:{k}>", part, more)


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html") -> None:
    """Write a record per row (null payload: empty) to gzip'd WARC files, one a task, in ``path``.

    Of payloads that are equal and at least 100 bytes long, the one with the smallest id is a response and the others are revisits
    of it; shorter ones are all responses. Every row makes a record of its own, also one that repeats an id and its payload: of rows
    with the smallest id each is a response. A null id has an empty page name and is the origin of no other; equal payloads whose
    ids are all null are all responses. Ids may be numbers or strings without ``>`` and line ends. Other columns are ignored.

    Scale: the smallest id of each digest is a map-side combined aggregate; payloads are shuffled once, to meet it. A digest that
    very many pages share is a skewed join, which adaptive execution splits.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), body.alias("body"))
    keyed = base.withColumn("digest", F.sha2("body", 256))
    long = F.octet_length("body") >= MIN_REVISIT
    origin = keyed.filter(long).groupBy("digest").agg(F.min("id").cast("string").alias("origin"), F.count(F.lit(1)).alias("n"))
    origin = origin.filter("n > 1").drop("n")
    rows = keyed.join(origin, "digest", "left").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "digest", "origin", "body")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, done = TaskContext.get().partitionId(), 0  # one file a task: numbers are the archive's own
        first = [_record("warcinfo", "<urn:page-archive>", "software: tapeline\r\nformat: WARC File Format 1.1", {"Content-Type": "application/warc-fields"})]
        for f in frames:
            for _, p in f.groupby(np.cumsum(f["body"].map(len).to_numpy()) // CHARS, sort=False):
                made = [r for k, x in enumerate(zip(p["id"], p["digest"], p["origin"], p["body"], strict=True), done) for r in records(*x, f"{task}-{k}")]
                done += len(p)
                yield pd.DataFrame({"value": first + made})
                first = []

    rows.mapInPandas(write, "value string").write.option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in ``path``: id, page, record_type, digest, refers_to (a page), payload. A page without a name is null.

    Spark's text source cuts the files at the records' first lines. A block whose length isn't its Content-Length fails the read.
    Continuations are grouped by their origin's id and ordered by number; numbers without gaps and the total length are required,
    then the HTTP head is removed and the chunks are joined. Revisits have no payload. Records without rows in the files give none.
    Only segmented records are shuffled; a group is one record.
    """
    raw = spark.read.option("lineSep", MARK).text(path)
    raw = raw.filter("value <> ''")  # before the first record of a file
    raw = raw.select(F.substring_index("value", "\r\n\r\n", 1).alias("head"), F.col("value").cast("binary").alias("raw"))
    segment = F.lower("head").contains("\r\nwarc-segment-number:")
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}: *<?([^>\r\n]*)", 1), F.lit(""))
    page = lambda name: F.nullif(F.expr(f"substr({name}, {len(PAGE) + 1})"), F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("wrong length of record "), "id"))
    block = F.expr("substr(raw, octet_length(head) + 5)")  # and two blank lines
    fields = {"id": field("WARC-Record-ID"), "record_type": field("WARC-Type"), "target": field("WARC-Target-URI"), "digest": field("WARC-Payload-Digest"), "length": field("Content-Length").cast("long"), "block": block}
    sized = F.when(F.octet_length("block") == F.col("length") + 4, F.expr("substr(block, 1, int(length))")).otherwise(wrong)
    whole = raw.filter(~segment).withColumns(fields | {"refers": field("WARC-Refers-To-Target-URI")}).filter("record_type <> 'warcinfo'")
    whole = whole.select("id", "target", "record_type", "digest", "refers", F.array(sized).alias("blocks"))
    more = {"number": field("WARC-Segment-Number").cast("int"), "origin": field("WARC-Segment-Origin-ID"), "total": field("WARC-Segment-Total-Length").cast("long")}
    parts = raw.filter(segment).withColumns(fields | more).withColumn("block", sized)
    parts = parts.groupBy(F.coalesce("origin", "id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("p"), F.max("total").alias("total"), F.max("digest").alias("digest"), F.max("target").alias("target")
    )
    length = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    good = (F.transform("p", lambda x: x["number"]) == F.sequence(F.lit(1), F.size("p"))) & (length == F.col("total"))
    blocks = F.when(good, F.transform("p", lambda x: x["block"])).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "id")))
    joined = parts.select("id", "target", F.lit("response").alias("record_type"), "digest", F.lit(None).cast("string").alias("refers"), blocks.alias("blocks"))
    every = whole.unionByName(joined).withColumn("payload", F.when(F.col("record_type") == "response", http_body("blocks")))
    return every.select("id", page("target").alias("page"), "record_type", "digest", page("refers").alias("refers_to"), "payload")


@F.pandas_udf(BinaryType())
def http_body(blocks: pd.Series) -> pd.Series:
    """The body of an HTTP response, joined from its blocks and out of its chunks where the head says so."""

    def body(parts: list[bytes] | None) -> bytes | None:
        if parts is None:
            return None
        head, _, rest = b"".join(bytes(x) for x in parts).partition(b"\r\n\r\n")
        return dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest

    return blocks.map(body)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of ``pages`` (page_id, html), read back from archives that
    are written first. Null html is an empty payload; null ids come back as null; rows that repeat give a row each; no pages, no rows."""
    write_warc(pages, path := shared_dir(spark, "warc"))
    number = lambda c: F.col(c).cast(pages.schema["page_id"].dataType)
    rows = read_warc(spark, path).select(
        "id", number("page").alias("page_id"), number("refers_to").alias("refers_to"), "record_type",
        F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("read"), F.regexp_replace("digest", "^sha256:", "").alias("said"),
    )
    rows = written(rows, "warc-records")  # two readers follow
    responses = rows.filter("record_type = 'response'")
    wrong = F.raise_error(F.concat(F.lit("digest differs: "), "id"))
    first = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.when(F.col("read") == F.col("said"), F.col("read")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to")
    sizes = responses.filter("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "said").agg(F.max("bytes").alias("payload_bytes"))
    again = rows.filter("record_type = 'revisit'").join(sizes, ["refers_to", "said"]).select("page_id", "payload_bytes", F.col("said").alias("payload_digest"), "record_type", "refers_to")
    return first.unionByName(again)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS origin FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND origin IS NOT NULL AND origin IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND origin IS DISTINCT FROM page_id THEN origin END AS refers_to
FROM q
"""

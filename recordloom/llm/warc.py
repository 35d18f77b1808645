"""WARC: write archives of captures, read them back, and assemble each transaction from its records.

Every page is written as three records (ISO 28500): a response or, if an earlier page has the same payload, a revisit
that refers to that page's response; the request; and metadata. Request and metadata name their capture by
``WARC-Concurrent-To``. Reading parses records by ``Content-Length`` (payloads may hold anything, blank lines
included) and joins the three records of a capture through the concurrent-to identifiers into one nested row.

The archives are real gzip-compressed ``.warc`` files in the shared folder: a record ends with two line breaks, which
is the line separator that Spark's text writer is given. Files hold a bounded number of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The separator between records, the date and the identifier prefix of written records.
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ID = "urn:record:"
#: Pages in an archive file, bytes of records that a reader holds before it passes them on.
PER_FILE, BATCH = 1_000, 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, name: str, uri: str, content_type: str, block: str, extra: list[str]) -> str:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", *extra, f"Content-Type: {content_type}", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + END + block


def _records(batches):
    """The three records of each page as strings. Ids come as text, or not at all."""
    for pdf in batches:
        out = []
        for name, url, html, first in zip(pdf["capture"], pdf["url"], pdf["html"], pdf["first"]):
            html = html.encode("utf-8", "replace").decode() if isinstance(html, str) else ""
            uri = "".join(str(url).split()) if isinstance(url, str) and url.split() else "about:blank"
            payload = html.encode()
            digest = f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}"
            if first is None:
                out.append(_record("response", f"{name}:capture", uri, "application/http; msgtype=response", head + html, [digest]))
            else:
                profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                out.append(_record("revisit", f"{name}:capture", uri, "application/http; msgtype=response", head, [digest, profile, f"WARC-Refers-To: <{ID}{first}:capture>"]))
            to = f"WARC-Concurrent-To: <{ID}{name}:capture>"
            out.append(_record("request", f"{name}:request", uri, "application/http; msgtype=request", f"GET {uri} HTTP/1.1{END}", [to]))
            out.append(_record("metadata", f"{name}:metadata", uri, "application/warc-fields", f"payload-bytes: {len(payload)}\r\n", [to]))
        yield pd.DataFrame({"value": out})


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write archives of ``pages`` (page_id, url, html) to ``path``.

    Of the pages with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response and
    the others are revisits of it; all smaller payloads are responses. Of rows that share the smallest page_id the one
    with the smallest capture name is the response (alike in url too, they have one name, and all are responses). Null
    html is the empty payload, a null or blank url is about:blank. A page without id is always a response. A capture
    is named by its page_id and a hash of its url and payload, so captures of a repeated page_id stay apart.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    page = F.col("page_id").cast("long")
    name = F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), F.hex(F.xxhash64("url", payload)))
    own = pages.select(page.alias("page_id"), "url", "html", name.alias("capture"), F.when(page.isNotNull() & (F.octet_length(payload) >= least), F.sha2(payload, 256)).alias("digest"))
    # Only payloads that occur twice have anything to say; the rows are combined before the exchange.
    shared = own.where("digest is not null").groupBy("digest").agg(F.min(F.struct("page_id", "capture")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = F.when(F.col("least.capture") != F.col("capture"), F.col("least.capture")).alias("first")
    lines = own.join(shared, "digest", "left").select("capture", "url", "html", first).mapInPandas(_records, "value string")
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * PER_FILE).text(path)


def parse(blob: bytes):
    """(headers, block) of each record of an archive, by Content-Length; headers lower-cased. Unpacks as it reads."""
    source = gzip.GzipFile(fileobj=io.BytesIO(blob)) if blob[:2] == b"\x1f\x8b" else io.BytesIO(blob)
    with io.BufferedReader(source) as stream:
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record: {line[:40]!r}")
            head = {}
            while (line := stream.readline()) not in (b"\r\n", b"\n"):
                if not line:
                    raise ValueError("a record head without end")
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) < size:
                raise ValueError(f"{head.get('warc-record-id')}: the block ends after {len(block)} of {size} bytes")
            yield head, block


RECORD = "capture string, type string, id string, uri string, refers_to string, digest string, payload_bytes string, declared string, payload binary, http_head string"


def _bare(x):
    return x.strip("<>").removeprefix(ID) if x else None


def _parsed(with_payload: bool):
    columns = RECORD.replace(" string", "").replace(" long", "").replace(" binary", "").split(", ")

    def run(batches):
        for pdf in batches:
            for blob in pdf["content"]:
                rows, size = [], 0
                for head, block in parse(bytes(blob)):
                    kind, payload, http, declared = head.get("warc-type"), None, None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        http = http.decode("utf-8", "replace")
                    elif kind == "metadata":
                        fields = dict(x.partition(":")[::2] for x in block.decode().split("\r\n") if x)
                        declared = fields.get("payload-bytes", "0").strip()
                    digest = head.get("warc-payload-digest")
                    if kind == "response" and digest is not None and f"sha1:{base32_sha1(payload)}" != digest:
                        raise ValueError(f"{head.get('warc-record-id')}: the payload does not have its digest")
                    own = _bare(head.get("warc-record-id"))
                    length = None if payload is None else str(len(payload))
                    rows.append((_bare(head.get("warc-concurrent-to")) or own, kind, own, head.get("warc-target-uri"), _bare(head.get("warc-refers-to")), digest and digest.removeprefix("sha1:"), length, declared, payload if with_payload else None, http))
                    size += len(block) if with_payload else 500
                    if size >= BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``path``; digests of responses are checked while reading."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    found = files.mapInPandas(_parsed(with_payload), RECORD)
    return found.withColumns({c: F.col(c).cast("long") for c in ("payload_bytes", "declared")})


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture, responses, requests, metadata, joined through concurrent-to identifiers.

    Repeated records of one kind in a capture come as a list; a capture without a response or revisit keeps its
    other records and an empty list.
    """
    of = lambda *kinds: F.filter("own", lambda x: x["type"].isin(*kinds))
    fields = F.struct("type", "id", "uri", "refers_to", "digest", "payload_bytes", "declared", "payload", "http_head")
    joined = records.groupBy("capture").agg(F.collect_list(fields).alias("own"))
    return joined.select(
        "capture",
        of("response", "revisit").alias("responses"),
        of("request").alias("requests"),
        of("metadata").alias("metadata"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of ``pages`` as archives, read them back, one row a page."""
    at = f"{C.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(C.table(spark, sf_dir, "pages"), at)
    C.release(spark)
    page = lambda x: F.substring_index(x, ":", 1).try_cast("long")
    captures = transactions(read_warc(spark, at, with_payload=False)).select(page(F.col("capture")).alias("page_id"), F.explode("responses").alias("r"), "metadata")
    return captures.select(
        "page_id",
        F.when(F.col("r.type") == "revisit", F.col("metadata")[0]["declared"]).otherwise(F.col("r.payload_bytes")).alias("payload_bytes"),
        F.col("r.digest").alias("payload_digest"),
        F.col("r.type").alias("record_type"),
        page(F.col("r.refers_to")).alias("refers_to"),
    )


#: base32 of SHA-1: four times 40 bits as eight digits of base 32, in the alphabet of RFC 4648.
_DIGEST = " || ".join(f"translate(to_base(CAST('0x' || substr(sha1(h), {i * 10 + 1}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in range(4))
ORACLE = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

"""A content-addressed web archive.

``store`` keeps each distinct payload once, under its SHA-256, in a table bucketed by digest, and every record's exact
header block in a table of its own; ``verify`` recomputes the digests from what was stored. ``records`` joins the two back
into the original records: only headers are shuffled to the buckets. ``write_archives`` writes the records as WARC/1.1 files
with Spark's own writer (any store that Spark reaches, no local files), and ``read_archives`` parses the files again, member
by member of a gzip file.

A payload of ``revisit_bytes`` or more has one response, so its join is one to one. A smaller one may be that of any share of
the records: its headers are dealt to ``SALTS`` copies of it.

Defined cases: null html is an empty payload; a null url leaves the target header out; line breaks in a url
are percent-encoded; rows that repeat a page_id and its payload are equal records, all responses; a null
page_id is kept and never the response that others refer to unless all are null; records of more than LARGE bytes go to
files of their own, of fewer records, so that a file holds FILE_BYTES at most, or one record; an empty table gives empty
archives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, materialize, new_path, table

#: Payloads from this size on are stored once in the archive, and revisited.
REVISIT_BYTES = 1000
#: Bytes of payload in a file at most, and of a payload that is no longer filed with the others.
FILE_BYTES, LARGE = 256 << 20, 1 << 20
#: Copies of each payload under REVISIT_BYTES in the join with its headers.
SALTS = 16
#: Bytes of payload in a batch of read records.
BATCH = 16 << 20
EOL = "\r\n"
ID = "urn:page:"
# Fixed value: what a revisit record with an equal payload names itself.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, digest, sha1, n_bytes, record_type, refers_to, header): all of a record but its payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    r = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    # only digests and ids are shuffled; a payload that many pages share is one row of the right side
    last = r.where(F.col("n_bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("last"))
    r = r.join(last, "digest", "left")
    response = (F.col("n_bytes") < revisit_bytes) | F.col("page_id").eqNullSafe(F.col("last"))
    r = r.withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    r = r.withColumn("refers_to", F.when(~response, F.col("last")))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(EOL))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, "").otherwise(line("WARC-Profile", F.lit(PROFILE))),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("n_bytes")).otherwise(0).cast("string")),
    )
    return r.select("page_id", "digest", "sha1", "n_bytes", "record_type", "refers_to", block.alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """(digest, payload): each distinct payload once; copies go before the shuffle."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), html.alias("payload")).dropDuplicates(["digest"])


def verify(stored: DataFrame) -> DataFrame:
    """``stored`` with each payload checked against its key; a wrong one stops the job."""
    good = F.sha2(F.encode("payload", "UTF-8"), 256) == F.col("digest")
    return stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.col("digest")))))


def store(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written tables of headers and of payloads."""
    return materialize(headers(pages), "warc-headers"), bucketed(payloads(pages), "digest", "warc-payloads")


def records(head: DataFrame, stored: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The archive's records: ``n_bytes`` and ``record``, header block and payload (none in a revisit).

    A payload is joined to its header by digest; length and SHA-1 must agree too, so that equal keys of
    different payloads can't pass.
    """
    own, small = head.where("record_type = 'response'"), F.octet_length("payload") < revisit_bytes
    once = own.where(F.col("n_bytes") >= revisit_bytes).join(stored.where(~small), "digest")
    salted = verify(stored.where(small)).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    often = own.where(F.col("n_bytes") < revisit_bytes).withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int"))
    full = verify(once.select("header", "n_bytes", "sha1", "digest", "payload")).union(often.join(salted, ["digest", "salt"]).select("header", "n_bytes", "sha1", "digest", "payload"))
    bytes_ = F.encode("payload", "UTF-8")
    same = (F.sha1(bytes_) == F.col("sha1")) & (F.octet_length(bytes_) == F.col("n_bytes"))
    body = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its record's digests")))
    again = head.where("record_type = 'revisit'").select(F.lit(0).cast("long").alias("n_bytes"), F.concat("header", F.lit(EOL)).alias("record"))
    return full.select("n_bytes", F.concat("header", F.lit(EOL), body).alias("record")).union(again)


def write_archives(recs: DataFrame, path: str, most: int | None = None) -> None:
    """Gzipped WARC files of recs(n_bytes, record), of which none has more than ``most`` bytes (counted if not given): the
    two line breaks after a record are the writer's line separator."""
    if most is None:
        most = recs.agg(F.max("n_bytes")).first()[0] or 0
    parts = [(recs.where(F.col("n_bytes") <= LARGE), LARGE)] if most > LARGE else [(recs, LARGE)]
    if most > LARGE:
        parts.append((recs.where(F.col("n_bytes") > LARGE), most))
    for part, size in parts:
        one = part.select("record").write.mode("append").option("lineSep", EOL + EOL).option("compression", "gzip")
        one.option("maxRecordsPerFile", max(1, FILE_BYTES // size)).text(path)


def unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of all members of a gzip file, piece by piece."""
    member, rest = zlib.decompressobj(31), memoryview(data)
    while len(rest):
        piece = member.decompress(rest[:step])
        rest = rest[step:]
        if piece:
            yield piece
        while member.eof:
            more = member.unused_data
            if not more and not len(rest):
                return
            member = zlib.decompressobj(31)
            if piece := member.decompress(more):
                yield piece
            if not more:
                break
    if len(data) and not member.eof:
        raise ValueError("the gzip file is cut off")


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a file that comes in pieces; one record is held at a time."""
    buf, at, place = bytearray(), 0, 0

    def upto(n: int) -> bool:
        nonlocal buf, at
        while len(buf) - at < n:
            more = next(pieces, None)
            if more is None:
                return False
            if at > 1 << 20:
                del buf[:at]
                at = 0
            buf += more
        return True

    while upto(1):
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not upto(len(buf) - at + 1):
                raise ValueError(f"record {place} is cut off")
        lines = buf[at:end].decode("utf-8").split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"record {place} is no WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        at = end + 4
        if not upto(n + 4) or buf[at + n : at + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record {place} is cut off")
        yield fields, bytes(buf[at : at + n])
        at, place = at + n + 4, place + 1


def _number(urn: str | None) -> int | None:
    return int(urn[len(ID) + 1 : -1]) if urn and urn[len(ID) + 1 : -1] else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, stated_sha1, payload_sha1, payload_bytes[, payload]) of each record."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                rows, size = [], 0
                for f, payload in parse_warc(unzipped(content)):
                    own = f["WARC-Type"] == "response"
                    row = (_number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["WARC-Type"], _number(f.get("WARC-Refers-To")), f["WARC-Payload-Digest"][5:], hashlib.sha1(payload).hexdigest() if own else None, len(payload) if own else None)
                    rows.append((*row, payload) if with_payload else row)
                    size += len(payload) if with_payload else 0
                    if size > BATCH or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    schema = "page_id long, url string, record_type string, refers_to long, stated_sha1 string, payload_sha1 string, payload_bytes long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, schema)


def resolved(read: DataFrame) -> DataFrame:
    """The read records, each revisit with size and digest of the response that it refers to."""
    own = read.where("record_type = 'response'").withColumn("ok", F.col("stated_sha1") == F.col("payload_sha1"))
    own = own.select("page_id", F.col("payload_bytes"), F.when(F.col("ok"), F.col("payload_sha1")).otherwise(F.raise_error(F.lit("a payload was changed in the archive"))).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    to = own.where("page_id is not null").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("stated")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = read.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to").alias("to"), F.col("stated_sha1").alias("stated"))
    again = again.join(to, ["to", "stated"], "left")
    return own.unionByName(again.select("page_id", "payload_bytes", F.col("stated").alias("payload_digest"), "record_type", F.col("to").alias("refers_to")))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, stored = store(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    path = new_path(spark, "warc")
    write_archives(records(head, stored), path, head.agg(F.max("n_bytes")).first()[0] or 0)
    read = materialize(read_archives(spark, path), "warc-read")
    return resolved(read)


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM q
"""

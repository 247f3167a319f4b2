"""WARC archives with segmented records.

Writing: every page is an HTTP response in chunked transfer framing.  A block longer than
``segment`` bytes is cut: its first part stays with the response record, the others become
``continuation`` records that name the origin's record ID and their segment number; the
last one carries the total length.  Equal payloads are stored once, the other pages get a
``revisit`` record.  Records end with two line breaks, so Spark's text writer with that
separator writes valid archives; pages are dealt to archives by page_id and a file holds at
most ``records`` records.

Reading: archives are cut into records by Content-Length, records of one origin are
grouped, ordered by segment number, checked for gaps and against the total length, and the
HTTP framing is decoded.  Payload digests are verified.

A record's segments must fit in one task, as its payload does; a file is read whole by one
task, so foreign archives should stay below 1 GB.

Defined cases: a null html is an empty payload; a null url is written as an empty one, control
characters in a url as %20; every row gets a record: rows that share a page_id, or have none, get
record IDs with their place among them; of equal payloads under the largest page_id the first
is the response; extra columns are ignored; empty tables give an empty result."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rowindex import places
from ..session import cut_lineage
from .common import arrow_map, ids_are_keys, join_sized, row_keys

CRLF = "\r\n"
END = CRLF + CRLF
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Transfer-Encoding: chunked" + END


def page_digests(pages: DataFrame) -> DataFrame:
    """(key, page_id, nth, url, payload binary, sha1 hex); ``key`` is the row's own, ``nth`` its place (from
    0) among the rows with its page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = row_keys(rows, "key", "page_id").withColumn("sha1", F.sha1("payload"))
    if ids_are_keys(rows, "page_id"):
        return keyed.withColumn("nth", F.lit(0).cast("long"))
    nth = places(keyed.select("key", "page_id"), ["page_id"], ["key"], "nth").select("key", "nth")
    return keyed.join(nth, "key")


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 8 groups of 20 bits, 4 letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(letters, F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                      for g in groups for s in (15, 10, 5, 0)])


def _pieces(data: Column, size: int) -> Column:
    n = F.octet_length(data)
    return F.when(n == 0, F.array().cast("array<binary>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")),
                    lambda i: F.substring(data, i * size + 1, F.lit(size))))


def chunked(payload: Column, chunk: int) -> Column:
    """Chunked transfer framing of a payload."""
    parts = F.transform(_pieces(payload, chunk), lambda p: F.concat(
        F.lower(F.hex(F.octet_length(p).cast("long"))).cast("binary"), F.lit(CRLF).cast("binary"), p, F.lit(CRLF).cast("binary")))
    body = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p))
    return F.concat(body, F.lit("0" + END).cast("binary"))


def _uid(page: Column, nth: Column, number: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("-")), number.cast("string"), F.when(nth > 0, nth.cast("string"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in
                                                            ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, segment: int, chunk: int, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, number, record binary) of all records, without the closing line breaks.
    Payloads of at least ``least`` bytes are stored once: with the largest page_id."""
    rows = page_digests(pages)
    narrow = cut_lineage(rows.where(F.octet_length("payload") >= least).select("key", "page_id", "nth", "sha1"), "page-digests")
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", (-F.col("nth")).alias("back"), "key"))
    holder = cut_lineage(narrow.groupBy("sha1").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "page-holders")
    again = join_sized(narrow, holder, ["sha1"], "n").where(F.col("key") != F.col("first.key")).select(
        "key", F.lit(True).alias("again"), F.col("first.page_id").alias("refers_to"), (-F.col("first.back")).alias("refers_nth"))
    told = rows.join(again, "key", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    page, nth = F.col("page_id"), F.col("nth")
    block = F.when(~F.col("again"), F.concat(F.lit(HTTP).cast("binary"), chunked(F.col("payload"), chunk))
                   ).otherwise(F.lit("HTTP/1.1 200 OK" + END).cast("binary"))
    cut = told.withColumn("block", block).withColumn("total", F.octet_length("block")) \
        .withColumn("parts", _pieces(F.col("block"), segment)).withColumn("n", F.size("parts")) \
        .select("page_id", "nth", "url", "sha1", "again", "refers_to", "refers_nth", "total", "n", F.posexplode("parts").alias("i", "part"))
    number = F.col("i") + 1
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    maybe = lambda cond, text: F.when(cond, text).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(F.col("i") > 0, F.lit("continuation")).when(~F.col("again"), F.lit("response"))
             .otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _uid(page, nth, number)), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.coalesce(line("WARC-Page", page.cast("string")), F.lit("")),
        maybe(F.col("again"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _uid(F.col("refers_to"), F.col("refers_nth"), F.lit(1))))),
        maybe(F.col("n") > 1, line("WARC-Segment-Number", number.cast("string"))),
        maybe(F.col("i") > 0, line("WARC-Segment-Origin-ID", _uid(page, nth, F.lit(1)))),
        maybe((F.col("n") > 1) & (number == F.col("n")), line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length("part").cast("string"), F.lit(END))
    return cut.select("page_id", number.alias("number"), F.concat(head.cast("binary"), F.col("part")).alias("record"))


def write(pages: DataFrame, path: str, segment: int = 16_384, chunk: int = 4096, least: int = 0,
          per_file: int = 2000) -> None:
    """Write archives (parts ``*.txt.gz`` in WARC format) into the folder ``path``."""
    recs = records(pages, segment, chunk, least)
    (recs.select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path))


def parse(raw: bytes):
    """(header fields in lower case, block) of each record of an archive."""
    at = 0
    while at < len(raw):
        if raw.startswith(b"\r\n", at):
            at += 2
            continue
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = raw[end + 4:end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, block
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records: record_id, type, uri, digest, page, refers, origin (its own ID for first
    segments), segment (0 for a record that is not segmented), total, block."""
    names = ["record_id", "type", "uri", "digest", "page", "refers", "origin", "segment", "total", "block"]

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                cols: list[list] = [[] for _ in names]

                def flush():
                    return pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary()])], names=names)

                size = 0
                for f, block in parse(gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob):
                    total = f.get("warc-segment-total-length")
                    row = (f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-payload-digest"),
                           f.get("warc-page"), f.get("warc-refers-to"), f.get("warc-segment-origin-id") or f.get("warc-record-id"),
                           int(f.get("warc-segment-number", 0)), int(total) if total else None, block)
                    for c, v in zip(cols, row):
                        c.append(v)
                    size += len(block)
                    if size > 4 << 20:
                        yield flush()
                        cols, size = [[] for _ in names], 0
                yield flush()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return arrow_map(files, run, "record_id string, type string, uri string, digest string, page string, refers string, "
                     "origin string, segment int, total long, block binary")


def reassembled(recs: DataFrame) -> DataFrame:
    """One row per origin record, its block put together from all segments in order.  A gap, a
    repeated segment or a wrong total length fails the job.  Records that are not segmented
    pass without a shuffle."""
    names = ("record_id", "type", "uri", "digest", "page", "refers")
    first = F.col("segment") == 1
    joined = recs.where("segment > 0").groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in names], F.max("total").alias("total"),
        F.max("segment").alias("last"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    out = joined.withColumn("block", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"])))
    ok = ((F.size("parts") == F.col("last")) & F.col("record_id").isNotNull()
          & (F.octet_length("block") == F.col("total")))
    checked = out.select(*names, F.when(ok, F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are incomplete"))).cast("binary")).alias("block"))
    return recs.where("segment = 0").select(*names, "block").unionByName(checked)


def decode_http(block: bytes) -> bytes:
    """Payload of an HTTP message, its transfer framing removed."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def payloads(origins: DataFrame) -> DataFrame:
    """Adds ``payload`` (null for revisits); a payload that does not match its digest fails the job."""
    def run(batches):
        for batch in batches:
            kinds, digests, blocks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("type", "digest", "block"))
            out = []
            for kind, digest, block in zip(kinds, digests, blocks):
                data = decode_http(block) if kind == "response" else None
                if data is not None and "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode() != digest:
                    raise ValueError(f"payload does not match {digest}")
                out.append(data)
            keep = ["record_id", "type", "uri", "digest", "page", "refers"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep]
                                             + [pa.array(out, pa.binary())], names=[*keep, "payload"])

    return arrow_map(origins, run, "record_id string, type string, uri string, digest string, page string, refers string, "
                     "payload binary")

"""WARC archives: a writer with revisit records and a reader that salvages what follows damage.

`write` makes one record per page as WARC/1.1 files, uncompressed, through Spark's text writer (records are UTF-8 text
and end with two line breaks, which is the writer's line separator), so any store that Spark writes to will do. Of the
records with equal payloads of at least `min_bytes`, the one with the largest id is the response; the others are revisit
records without a payload that name it, its digest and its length.

`read` walks each file by the lengths in its headers, plain or as gzip members. A record whose version line, header,
length, end mark, gzip check or payload digest fails isn't trusted: the reader searches for the next version line or
gzip member that parses, goes on from there, and logs the bytes in between as quarantined. A damaged gzip member is searched
for its version lines too, as far as it inflates; its place is logged, and its records are trusted by their own digests.

Defined results: a null payload is empty; a payload over 4 MB has a file of its own, up to the 2 GB of a Spark value; the larger of equal ids doesn't exist, so rows that repeat an id are written
as often as they come, the first of them as what they are; pages with a null id are responses without an id and never
referred to; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filled, scratch

END = "\r\n\r\n"
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
#: Gzip members are inflated in steps of so many bytes.
STEP = 1 << 18
#: Records a file, by payload bytes: a reader's task holds a file, so files of several records hold 128 MB at most.
PER_FILE = ((0, 2000), (64 << 10, 32), (4 << 20, 1))
#: So many shared digests (about 50 bytes each) at most are broadcast.
BROADCAST_DIGESTS = 200_000
URN = "urn:page:"


def digest(body: Column) -> Column:
    """Upper-case base32 SHA-1: 8 times 20 bits as 4 digits."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(body), 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(
        F.upper(F.concat(*[part(i) for i in range(8)])), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Per page: id, url, body, n_bytes, sha, refers_to (null for responses)."""
    body = filled(F.col(body_col))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("body")
    )
    rows = rows.withColumn("n_bytes", F.octet_length("body").cast("long")).withColumn("sha", digest(F.encode("body", "UTF-8")))
    shared = (
        rows.filter((F.col("n_bytes") >= min_bytes) & F.col("id").isNotNull())
        .groupBy("sha")
        .agg(F.max("id").alias("last"), F.min("id").alias("first"))
        .filter(F.col("last") > F.col("first"))
        .select("sha", "last")
    )
    shared = cut(shared)
    if shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:  # else the payloads are shuffled by digest
        shared = F.broadcast(shared)
    refers = F.when((F.col("n_bytes") >= min_bytes) & (F.col("id") < F.col("last")), F.col("last"))
    return rows.join(shared, "sha", "left").withColumn("refers_to", refers).drop("last")


def record(p: DataFrame) -> Column:
    """The text of a record, without its end mark."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    again = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    body = F.when(again, F.lit("")).otherwise(F.col("body"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", urn(F.col("refers_to"))),
                line("X-Payload-Length", F.col("n_bytes").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write(pages: DataFrame, path: str, per_file: tuple[tuple[int, int], ...] = PER_FILE, **columns) -> None:
    """Archives below path, a folder for each class of sizes that has pages."""
    p = plan(pages, **columns)
    least = [n for n, _ in per_file]
    size = F.octet_length(filled(F.col(columns.get("body_col", "html"))))
    found = [r[0] for r in pages.select(sum((size >= n).cast("int") for n in least).alias("k")).distinct().collect()]  # a row per class
    for k in sorted(found) or [1]:
        some = p.filter(F.col("n_bytes") >= least[k - 1])
        some = some.filter(F.col("n_bytes") < least[k]) if k < len(least) else some
        out = some.select(record(some).alias("value")).write.option("lineSep", END)
        out.option("maxRecordsPerFile", per_file[k - 1][1]).text(f"{path}/from-{least[k - 1]}")


_HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")


def _parse(buf: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, payload and end of the record at a place; or why there is none."""
    m = _HEADER.match(buf, at)
    if not m:
        return "header" if buf.startswith(VERSION, at) else "version line"
    try:
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in m[1].decode().split("\r\n") if x)}
        size = int(head["content-length"])
    except (ValueError, KeyError):
        return "header"
    end = m.end() + size
    if size < 0 or buf[end : end + 4] != END.encode():
        return "length"
    body = buf[m.end() : end]
    known = head.get("warc-payload-digest", "")
    if known.startswith("sha1:") and head.get("warc-type") != "revisit":
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != known[5:]:
            return "digest"
    return head, body, end + 4


def _member(buf: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at a place inflates to, and its end; None as the end if it is cut off or fails its check."""
    z, out, view = zlib.decompressobj(31), [], memoryview(buf)
    while at < len(buf) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(view[at : at + STEP]))
        except zlib.error:  # what the step inflates before its fault, byte by byte
            try:
                for p in range(at, min(at + STEP, len(buf))):
                    out.append(before.decompress(view[p : p + 1]))
            except zlib.error:
                pass
            return b"".join(out), None
        at += STEP
    return b"".join(out), min(at, len(buf)) - len(z.unused_data) if z.eof else None


def _inside(content: bytes, whole: bool) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """The records of a member's content, also those after damage, and why bytes were left out (empty if none were).

    Of a member that isn't whole, a record is trusted by its own payload digest only.
    """
    found, why, p = [], "" if whole else "gzip member", 0
    while p < len(content):
        got = _parse(content, p)
        if isinstance(got, str):
            why = why or got
            p = content.find(VERSION, p + 1)
            if p < 0:
                break
            continue
        if whole or (got[0].get("warc-payload-digest", "").startswith("sha1:") and got[0].get("warc-type") != "revisit"):
            found.append(got[:2])
        p = got[2]
    return found, why


def salvage(buf: bytes) -> Iterator[tuple]:
    """("record", headers, payload, start, end) and ("gap", reason, None, start, end) in the order of the file.

    Places are those of the file. Records of a damaged gzip member have the member's place, which is a gap as well.
    """
    at, n, gap, why = 0, len(buf), None, ""

    def next_start(p: int) -> int:
        found = [x for x in (buf.find(VERSION, p), buf.find(GZIP, p)) if x >= 0]
        return min(found, default=n)

    while at < n:
        zipped = buf.startswith(GZIP, at)
        if zipped:
            content, end = _member(buf, at)
            found, damage = _inside(content, end is not None)
            stop = next_start(at + 1) if end is None else end
        else:
            got = _parse(buf, at)
            damage = got if isinstance(got, str) else ""
            found, stop = ([], next_start(at + 1)) if damage else ([got[:2]], got[2])
        if gap is not None and (found or not damage):
            yield "gap", why, None, gap, at
            gap = None
        for head, body in found:
            yield "record", head, body, at, stop
        if damage:
            gap, why = (at, damage) if gap is None else (gap, why)
            if zipped and end is not None:  # what follows a whole member is not part of its gap
                yield "gap", why, None, gap, stop
                gap = None
        at = stop
    if gap is not None:
        yield "gap", why, None, gap, n


READ = (
    "kind string, file string, start long, stop long, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def _id(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _rows(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in READ.split(", ")])
        for b in batches:
            for i in range(b.num_rows):
                file, rows, held = b.column("path")[i].as_py(), [], 0
                for kind, head, body, start, stop in salvage(b.column("content")[i].as_py()):
                    if kind == "gap":
                        rows.append((kind, file, start, stop, head, *[None] * 7))
                        continue
                    again = head.get("warc-type") == "revisit"
                    size = head.get("x-payload-length") if again else len(body)
                    sha = head.get("warc-payload-digest", "")[5:] if again else base64.b32encode(hashlib.sha1(body).digest()).decode()
                    rows.append(
                        (kind, file, start, stop, None, _id(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-type"),
                         _id(head.get("warc-refers-to")), None if size is None else int(size), sha, body if with_payload else None)
                    )
                    held += len(body) if with_payload else 0
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files below path; payload is null for revisit records and unless payloads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_rows(payloads), READ)


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> tuple[DataFrame, DataFrame]:
    """Writes the pages and reads the archives back: records and quarantined gaps."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path, **columns)
    found = read(spark, path, payloads=False)
    return found.filter("kind = 'record'"), found.filter("kind = 'gap'")

"""Conversion of legacy ARC archives to WARC.

An ARC archive opens with a version block (``filedesc://``) whose second line names the version and
whose third names the fields of the header lines: five in version 1, ten in version 2. Every
record is one header line, the declared number of bytes, and a line feed. The converter reads
header lines by the version that the archive states, takes payloads by their declared lengths, and
synthesises what WARC asks for: a record identifier made from the record's own content, an ISO 8601
timestamp, the record type, the content type and SHA-1 digests.

Archives are single columns of text written by Spark, one record per row: each record ends in a
line feed, which is the separator that Spark's text writer puts after it. They are read as whole gzip
files, whose number follows the bytes to write, so that one file holds about ``archive_bytes``.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded, materialize, salted_join, new_path

ARCHIVE_BYTES = 16 << 20
#: Rows of a 32-character digest and a number, about 10 MB.
BROADCAST_DIGESTS = 100_000

#: Header fields of ARC versions 1 and 2. Fixed values.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_DATE = "19700101000000"


class ArchiveError(ValueError):
    """An archive whose headers or declared lengths don't fit its bytes."""


def header_line(version: int, page_id: Column, url: Column, length: Column) -> Column:
    """The header line of a record, without its line feed; white space in the URL is percent-encoded.

    Version 1 has no field for the page's identifier, so there the URL carries it as a fragment ``#page-N``;
    the version 2 record names it in its checksum field.
    """
    place = F.coalesce(url, F.lit(""))
    for c in " \t\n\x0b\f\r":
        place = F.replace(place, F.lit(c), F.lit(f"%{ord(c):02X}"))
    name, size, fixed = F.concat(F.lit("page-"), F.coalesce(page_id.cast("string"), F.lit("null"))), length.cast("string"), map(F.lit, ("0.0.0.0", _DATE, "text/html"))
    if version == 1:
        return F.concat_ws(" ", F.concat(place, F.lit("#"), name), *fixed, size)
    return F.concat_ws(" ", F.when(place == "", "-").otherwise(place), *fixed, F.lit("200"), name, F.lit("-"), F.lit("0"), F.lit("pages.arc"), size)


def version_block(version: int) -> bytes:
    """The block that opens an archive, up to its last line feed."""
    body = b"%d 0 Pagewright\n%s\n" % (version, b" ".join(x.encode() for x in ARC_FIELDS[version]))
    return b"filedesc://pages.arc 0.0.0.0 %s text/plain %d\n%s" % (_DATE.encode(), len(body), body)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(header by field name, payload) of an archive's records after its version block.

    The version block's own declared length bounds it; its lines name version and fields. A header
    line has as many fields as that version states (a URL holds no white space); lengths that
    run past the end, lines of another number of fields and unknown versions raise ArchiveError.
    Line feeds between records are skipped. An empty archive has no records.
    """
    if not data.strip():
        return
    end = data.find(b"\n")
    first = data[:end].split(b" ")
    if not first[0].startswith(b"filedesc://") or len(first) != 5 or not first[4].isdigit():
        raise ArchiveError("no version block")
    at = end + 1 + int(first[4])
    lines = data[end + 1 : at].split(b"\n")
    version = int(lines[0].split(b" ")[0])
    fields = tuple(lines[1].decode().split(" "))
    if fields != ARC_FIELDS.get(version):
        raise ArchiveError(f"version {version} doesn't have the fields {fields}")
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        values = data[at:end].split(b" ")
        if end < 0 or len(values) != len(fields) or not values[-1].isdigit():
            raise ArchiveError(f"header line at {at}")
        size = int(values[-1])
        if end + 1 + size > len(data):
            raise ArchiveError(f"payload at {end + 1} is cut off")
        yield dict(zip(fields, values)), data[end + 1 : end + 1 + size]
        at = end + 1 + size


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of a WARC archive's records, taken by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.1\r\n", at):
            raise ArchiveError(f"record at {at}")
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        headers = {k: v for k, _, v in (line.partition(": ") for line in lines)}
        size = int(headers["Content-Length"])
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ArchiveError(f"declared length of the record before {at}")
        yield headers, data[end + 4 : at]
        at += 4


def sha1_base32(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def timestamp(arc_date: bytes) -> str:
    """ISO 8601 of a 14-digit ARC date; shorter dates are filled up, anything else is the epoch."""
    d = arc_date.decode("ascii", "replace")
    if not d.isdigit() or not 4 <= len(d) <= 14:
        d = _DATE
    d = d + _DATE[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(digest: str, page_id: str) -> str:
    """A UUID (version 5) of the page and its payload's digest: reruns make the same identifiers."""
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(kind: str, page_id: str, url: str, date: str, digest: str, payload: bytes, refers_to: str | None, refers_to_date: str | None = None) -> bytes:
    """One record. A revisit's block is empty; it names the length of the payload that it stands for, and the original's identifier and date."""
    block = payload if kind == "response" else b""
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(digest, page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", page_id),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(digest, refers_to)), ("WARC-Refers-To-Date", refers_to_date or date), ("X-Refers-To-Page-ID", refers_to)]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in headers) + b"\r\n" + block + b"\r\n\r\n"


def _write(records: DataFrame, path: str) -> None:
    """Writes the column ``record`` (text, with its last line feed left to the writer), one gzip file a partition."""
    records.select("record").write.option("compression", "gzip").text(path)


def _read(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _archives(total: int, archive_bytes: int) -> int:
    return max(1, -(-total // archive_bytes))


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as ARC archives: even archives in version 1, odd ones in version 2. Null html is an empty payload."""
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    total = clean.agg(F.sum(F.octet_length("html") + 300).cast("long")).first()[0] or 0
    n = _archives(total, archive_bytes)
    dealt = clean.repartition(n)  # round robin, so that archives are of one size whatever ids and URLs repeat
    v1, v2 = (header_line(v, F.col("page_id"), F.col("url"), F.octet_length("html")) for v in (1, 2))
    number = F.monotonically_increasing_id()  # partition number above, row number below
    with_place = dealt.select("*", F.shiftright(number, 33).alias("archive"), number.bitwiseAND((1 << 33) - 1).alias("row"))
    odd = F.col("archive") % 2 == 1
    opening = F.when(F.col("row") > 0, "").when(odd, version_block(2).decode()).otherwise(version_block(1).decode())
    _write(with_place.select(F.concat(opening, F.when(odd, v2).otherwise(v1), F.lit("\n"), "html").alias("record")), path)


def read_arc(spark, path: str) -> DataFrame:
    """(page_id, url, date, digest, html) of every record of the ARC archives in ``path``; page_id is text."""
    import pyarrow as pa

    names = ["page_id", "url", "date", "digest", "html"]

    def run(batches):
        for batch in bounded(batches):
            for data in batch.column(0):
                rows = []
                for header, payload in arc_records(gzip.decompress(data.as_py())):
                    url = header["URL"].decode("utf-8", "replace")
                    if "Checksum" in header:
                        page = header["Checksum"].decode()
                    else:
                        url, _, page = url.rpartition("#")
                    rows.append((page.removeprefix("page-"), url, timestamp(header["Archive-date"]), sha1_base32(payload), payload))
                    if len(rows) == 200:
                        yield _batch(rows, names, 4)
                        rows = []
                if rows:
                    yield _batch(rows, names, 4)

    def _batch(rows, names, binary):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == binary else pa.string()) for k in range(len(names))], names)

    return _read(spark, path).mapInArrow(run, "page_id string, url string, date string, digest string, html binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (page_id, url, date, digest, html, kind, refers_to, refers_to_date) as WARC archives, one for each partition."""
    import pyarrow as pa

    def run(batches):
        for batch in bounded(batches, 200):
            rows = batch.to_pylist()
            out = [warc_record(r["kind"], r["page_id"], r["url"], r["date"], r["digest"], r["html"], r["refers_to"], r["refers_to_date"])[:-1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    columns = ["page_id", "url", "date", "digest", "html", "kind", "refers_to", "refers_to_date"]
    _write(records.select(columns).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record")), path)


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) as the archives in ``path`` have them.

    A response's digest and length are computed from the block that was read and must equal the headers'.
    """
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(text):
        return None if text in (None, "null") else int(text)

    def run(batches):
        for batch in bounded(batches):
            for data in batch.column(0):
                rows = []
                for h, block in warc_records(gzip.decompress(data.as_py())):
                    digest, size, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h["WARC-Type"]
                    if kind == "response" and (digest != sha1_base32(block) or size != len(block)):
                        raise ArchiveError(f"payload of {h['WARC-Record-ID']}")
                    rows.append((number(h["X-Page-ID"]), h["WARC-Target-URI"], size, digest, kind, number(h.get("X-Refers-To-Page-ID")), block))
                    if len(rows) == 200:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return _read(spark, path).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def mark_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds kind, refers_to and refers_to_date: of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is the response.

    Only digests that occur twice or more go into the join. Up to BROADCAST_DIGESTS of them are sent to the
    records; beyond that the join is salted, as one payload may be a third of all records. Repeated rows of the largest page_id are all responses, as a page doesn't
    refer to itself; null page_ids come below all others.
    """
    number = F.expr("try_cast(page_id as bigint)")
    long_enough = F.octet_length("html") >= least_bytes
    best = records.where(long_enough).groupBy("digest").agg(F.max(number).alias("best"), F.max_by("date", number).alias("best_date"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null").select("digest", "best", "best_date")
    best = materialize(best, "warc-originals")
    if best.count() <= BROADCAST_DIGESTS:
        out = records.join(F.broadcast(best), "digest", "left")
    else:
        out = salted_join(records, best, ["digest"], ["page_id", "url"])
    revisit = long_enough & F.col("best").isNotNull() & ~F.col("best").eqNullSafe(number)
    return out.select(*records.columns, F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("best").cast("string")).alias("refers_to"), F.when(revisit, F.col("best_date")).alias("refers_to_date"))


def convert(spark, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Converts the ARC archives in ``arc_path`` to WARC archives in ``warc_path``; reads them twice, once for the digests alone."""
    write_warc(mark_revisits(read_arc(spark, arc_path), least_bytes), warc_path)


def archive_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ARC, converts to WARC and returns what ``read_warc`` reads.

    Null html is an empty payload, a null url an empty target, a null page_id stays null. Repeated
    rows are records of their own; an empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, archive_bytes)
    convert(spark, arc, warc, least_bytes)
    return read_warc(spark, warc)

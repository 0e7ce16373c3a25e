"""Legacy ARC archives converted to WARC.

An ARC file begins with a version block that says which fields the header line of every record has
(five in version 1, ten in version 2); the last field is the declared length of what follows.  The
converter reads records by these lines and lengths and synthesises what WARC asks for: record ids (from
the archive's name and the record's place in it), ISO timestamps, record types, block and payload digests.
Of records with equal payloads the one with the largest id (header ``X-Page-Id`` of the stored response)
stays a response; the others become revisits of it, without payload.

Archives are written by Spark's text writer, one per task, so that a lost task leaves none behind:
a record is a line, and the line separator is the blank line that ends a record.  They are gzipped and
read back as binary files; records are cut one by one while unpacking.

Defined results: a null payload is empty; a null url becomes ``urn:unknown``, white space in urls is
escaped; records without id rank below all others, equal ids are told apart by record id; repeated rows
are records of their own; an empty table gives an empty result; a length that runs past the end of an
archive or a malformed header line raises ValueError.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.shared import new_folder, stored

from .text import batch, raw

# Fixed values of the formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_SEPARATOR, WARC_SEPARATOR = "\n", "\r\n\r\n"
ID_HEADER = "X-Page-Id"
FETCHED = "20000101000000"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- ARC -----------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 panelstats\n{' '.join(ARC_FIELDS[version])}\n".encode()
    middle = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {FETCHED} text/plain{middle} {len(body)}\n".encode() + body


def arc_record(version: int, url: str | None, block: bytes, name: str, fetched: str = FETCHED) -> bytes:
    shown = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:unknown"
    middle = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{shown} 0.0.0.0 {fetched} text/html{middle} {len(block)}\n".encode("utf-8", "surrogatepass") + block


def parse_arc(stream: io.BufferedIOBase) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """version, offset, header fields and content of each record after the version block."""
    version, at = 0, 0
    while line := stream.readline():
        begins, at = at, at + len(line)
        if not line.strip():
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        names = ARC_FIELDS.get(version, ())
        if not version:
            length = int(text.rsplit(" ", 1)[1])
        else:
            fields = text.rsplit(" ", len(names) - 1)
            if len(fields) != len(names) or not fields[-1].isdigit():
                raise ValueError(f"header line at {begins} hasn't the {len(names)} fields of version {version}")
            length = int(fields[-1])
        content = stream.read(length)
        if len(content) < length:
            raise ValueError(f"record at {begins} declares {length} bytes and has {len(content)}")
        at += length
        if not version:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"version {version} of ARC isn't known")
            continue
        yield version, begins, dict(zip(names, fields, strict=True)), content


def http_response(payload: bytes, record_id: int | None) -> bytes:
    known = "" if record_id is None else f"{ID_HEADER}: {record_id}\r\n"
    head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields, and payload of a stored response."""
    at = block.find(b"\r\n\r\n") + 4
    if at < 4 or not block.startswith(b"HTTP/"):
        return b"", {}, block
    fields = (line.partition(":") for line in block[: at - 4].decode("latin-1").split("\r\n")[1:])
    return block[:at], {k.lower(): v.strip() for k, _, v in fields}, block[at:]


def write_arcs(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str) -> None:
    """One archive per task, of version 1 and 2 by turns."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema, part = pa.schema([("value", pa.binary())]), TaskContext.get().partitionId()
        version, name, begun = part % 2 + 1, f"part-{part:05d}.arc", False
        for rows in batches:
            if not rows.num_rows:
                continue
            out = [] if begun else [arc_version_block(version, name)]
            begun = True
            for record_id, url, html in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                out.append(arc_record(version, url, http_response(raw(html), record_id), name))
            yield batch(schema, value=out)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    _write(rows.mapInArrow(records, "value binary"), path, ARC_SEPARATOR)


def _write(records: DataFrame, path: str, separator: str) -> None:
    """Bytes of the records as they are, each followed by the separator."""
    lines = records.select(F.col("value").cast("string").alias("value"))
    lines.write.options(lineSep=separator, compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _unpacked(content: bytes) -> io.BufferedIOBase:
    plain = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 18) if content[:2] == b"\x1f\x8b" else plain


#: Records are handed on in lots of about this many bytes.
LOT_BYTES = 8_000_000


def read_arcs(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Records: record_id, url, ip, fetched, mime, version, id, payload_bytes, payload_digest, and block."""
    fields = [("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("fetched", pa.string())]
    fields += [("mime", pa.string()), ("version", pa.int32()), ("id", pa.int64())]
    fields += [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("block", pa.binary())] * with_block
    schema = pa.schema(fields)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, content in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                name, lot, size = path.rsplit("/", 1)[-1], [], 0
                for version, at, head, block in parse_arc(_unpacked(content.as_py())):
                    _, http, payload = http_parts(block)
                    known = http.get(ID_HEADER.lower())
                    lot.append(
                        (
                            f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}>",
                            head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"],
                            version, int(known) if known else None, len(payload), base32_sha1(payload),
                        )
                        + (block,) * with_block
                    )
                    size += 300 + len(block) * with_block
                    if size > LOT_BYTES:
                        yield _lot(schema, lot)
                        lot, size = [], 0
                if lot:
                    yield _lot(schema, lot)

    kinds = "record_id string, url string, ip string, fetched string, mime string, version int, id long, "
    kinds += "payload_bytes long, payload_digest string" + ", block binary" * with_block
    return _files(spark, path).mapInArrow(records, kinds)


def _lot(schema: pa.Schema, lot: list[tuple]) -> pa.RecordBatch:
    return batch(schema, **dict(zip(schema.names, map(list, zip(*lot, strict=True)), strict=True)))


# -- WARC ----------------------------------------------------------------------------------------


def iso_time(fetched: str) -> str:
    """WARC-Date of a 14-digit ARC date; missing digits are the earliest possible."""
    d = fetched + "00000101000000"[len(fetched) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, record_id: str, block: bytes, fields: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, **fields, "Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode("utf-8", "surrogateescape") + block


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, lower-cased names, and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            head[name.lower()] = value.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"record {head.get('warc-record-id')} declares {length} bytes and has {len(block)}")
        yield head, block


def find_revisits(records: DataFrame) -> DataFrame:
    """record_id and the response it repeats (refers_to, its url and date); nothing else is moved.

    Digests are counted before they are joined, so a payload that a third of all records have is one row
    on its side of the join; the other side is skewed by short rows that Spark can split.
    """
    kept = records.groupBy("payload_digest").agg(
        F.max(F.struct(F.coalesce("id", F.lit(-(2**63))).alias("rank"), "record_id", "url", "fetched")).alias("kept"),
        F.count("*").alias("copies"),
    )
    some = kept.filter(F.col("copies") > 1).select("payload_digest", "kept.*")
    some = some.toDF("payload_digest", "rank", "refers_to", "refers_url", "refers_fetched").drop("rank")
    return (
        records.select("record_id", "payload_digest")
        .join(some, "payload_digest")
        .filter(F.col("record_id") != F.col("refers_to"))
        .drop("payload_digest")
    )


def convert(spark: SparkSession, arcs: str, warcs: str) -> None:
    """Read ARC archives below one path and write WARC archives below another."""
    revisits = stored(find_revisits(stored(read_arcs(spark, arcs, with_block=False), "arc-records")), "arc-revisits")
    marked = read_arcs(spark, arcs).join(revisits, "record_id", "left")
    names = marked.columns

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, begun = pa.schema([("value", pa.binary())]), False
        for rows in batches:
            if not rows.num_rows:
                continue
            out = []
            if not begun:
                begun, about = True, b"software: panelstats\r\nformat: WARC File Format 1.0\r\n"
                info = {"WARC-Date": iso_time(FETCHED), "Content-Type": "application/warc-fields"}
                out.append(warc_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", about, info))
            for values in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                r = dict(zip(names, values, strict=True))
                head, _, _ = http_parts(r["block"])
                block = r["block"] if r["refers_to"] is None else head
                fields = {"WARC-Target-URI": r["url"], "WARC-Date": iso_time(r["fetched"]), "WARC-IP-Address": r["ip"]}
                fields["WARC-Payload-Digest"] = f"sha1:{r['payload_digest']}"
                fields["WARC-Block-Digest"] = f"sha1:{base32_sha1(block)}"
                fields["Content-Type"] = "application/http; msgtype=response" if head else r["mime"]
                if r["refers_to"] is not None:
                    fields |= {"WARC-Refers-To": r["refers_to"], "WARC-Refers-To-Target-URI": r["refers_url"]}
                    fields |= {"WARC-Refers-To-Date": iso_time(r["refers_fetched"]), "WARC-Profile": REVISIT_PROFILE}
                kind = "response" if r["refers_to"] is None else "revisit"
                out.append(warc_record(kind, r["record_id"], block, fields))
            yield batch(schema, value=out)

    _write(marked.mapInArrow(records, "value binary"), warcs, WARC_SEPARATOR)


def read_warcs(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records but warcinfo: record_id, record_type, id, url, date, payload_bytes, payload_digest, refers_to_record.

    The digest of a response is computed from what was read and must be the declared one; of a revisit,
    length and digest are those that it declares for the full payload.
    """
    fields = [(n, pa.string()) for n in ("record_id", "record_type", "url", "date")]
    fields += [("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string())]
    fields += [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for content in rows.column(1):
                lot, size = [], 0
                for head, block in parse_warc(_unpacked(content.as_py())):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    declared = head["warc-payload-digest"].removeprefix("sha1:")
                    n, digest = int(http.get("content-length", 0)), declared
                    if kind == "response":
                        n, digest = len(payload), base32_sha1(payload)
                        if digest != declared:
                            raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                    known = http.get(ID_HEADER.lower())
                    lot.append(
                        (head["warc-record-id"], kind, head.get("warc-target-uri"), head["warc-date"], int(known) if known else None, n, digest, head.get("warc-refers-to"))
                        + (payload,) * with_payload
                    )
                    size += 300 + len(payload) * with_payload
                    if size > LOT_BYTES:
                        yield _lot(schema, lot)
                        lot, size = [], 0
                if lot:
                    yield _lot(schema, lot)

    kinds = "record_id string, record_type string, url string, date string, id long, payload_bytes long, "
    kinds += "payload_digest string, refers_to_record string" + ", payload binary" * with_payload
    return _files(spark, path).mapInArrow(records, kinds)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The records with refers_to: the id of the response that a revisit repeats."""
    revisits = records.filter(F.col("record_type") == "revisit")
    asked = revisits.select(F.col("refers_to_record").alias("asked")).distinct()
    found = records.join(asked, F.col("record_id") == F.col("asked")).select("asked", F.col("id").alias("refers_to"))
    return records.join(found, F.col("refers_to_record") == F.col("asked"), "left").drop("asked")


def round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", arcs: str | None = None, warcs: str | None = None
) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back; paths default to the shared folder."""
    spark = pages.sparkSession
    arcs, warcs = arcs or new_folder(spark, "arc"), warcs or new_folder(spark, "warc")
    write_arcs(pages, arcs, id_col, url_col, payload_col)
    convert(spark, arcs, warcs)
    return resolve_revisits(stored(read_warcs(spark, warcs), "warc-records"))

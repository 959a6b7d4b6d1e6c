"""Web archives: a converter of legacy ARC files to WARC, a writer, and a reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.llm.common import new_path, stage, table

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Records in an archive file.
FILE_RECORDS = 2000
#: The fields of an ARC record's header line, by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:plateloom:arc-record")


# --- ARC --------------------------------------------------------------------------------------------------------------
def arc_version_block(version: int, name: str = "pages.arc", date: str = "19960923142103") -> bytes:
    """The block that begins an ARC file and says which fields its header lines have."""
    labels = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 plateloom\n{labels[version]}\n\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, payload: bytes, url: str, date: str = "19960923142103", kind: str = "text/html", ip: str = "0.0.0.0", filename: str = "-") -> bytes:
    """A record of an ARC file; blanks and controls in the URL are escaped."""
    digest = hashlib.sha1(payload).hexdigest()
    fields = {"url": quote(url, safe="%/:=&?~#+!$,;'@()*[]|") or "-", "ip": ip, "date": date, "type": kind or "no-type", "result": "200", "checksum": digest, "location": "-", "offset": "0", "filename": filename, "length": str(len(payload))}
    return b"\n" + " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + payload


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and payload of each record of an ARC file, its version block first.

    The version block's second line names the fields of later header lines. Lengths are taken from the header lines; line
    feeds between records are skipped. A header line with too few fields, a length that isn't a number, or a payload
    that ends early raises ValueError.
    """
    at, version = 0, 0
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line doesn't end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not version:
            found = re.match(r"([12]) ", data[end + 1 : end + 16].decode("utf-8", "replace"))
            if not line.startswith("filedesc:") or not found:
                raise ValueError("no version block")
            version = int(found[1])
        values = line.split(" ")
        if len(values) < len(ARC_FIELDS[version]):
            raise ValueError(f"{len(values)} fields in a header line of version {version}")
        # URLs of old crawlers may hold blanks: the other fields are counted from the end
        extra = len(values) - len(ARC_FIELDS[version])
        head = dict(zip(ARC_FIELDS[version], [" ".join(values[: extra + 1]), *values[extra + 1 :]]))
        size = int(head["length"])
        if size < 0 or end + 1 + size > len(data):
            raise ValueError("a payload ends early")
        yield head | {"version": str(version)}, data[end + 1 : end + 1 + size]
        at = end + 1 + size


# --- ARC to WARC ------------------------------------------------------------------------------------------------------
def _utc(date: str) -> str:
    digits = re.sub(r"\D", "", date)
    digits = (digits + "19700101000000"[len(digits) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_fields(head: dict[str, str], payload: bytes) -> list[tuple[str, str]]:
    """The WARC header that an ARC record is given: type, identifier, timestamp, digest and length.

    A version block becomes warcinfo, what was fetched over HTTP response, anything else resource. Identifiers depend
    on the record alone, so that a second conversion gives the same ones.
    """
    sha1 = hashlib.sha1(payload).digest()
    name = "|".join((head["url"], head["date"], head.get("filename", "-"), sha1.hex()))
    kind = "warcinfo" if head["url"].startswith("filedesc:") else "response" if re.match(r"https?:", head["url"]) else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"), ("WARC-Date", _utc(head["date"]))]
    if kind != "warcinfo":
        fields += [("WARC-Target-URI", head["url"]), ("WARC-IP-Address", head["ip"])]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()), ("X-Source-File", head.get("filename", "-"))]
    return [*fields, ("Content-Type", head["type"]), ("Content-Length", str(len(payload)))]


def warc_record(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + payload + b"\r\n\r\n"


def arc_to_warc(data: bytes) -> bytes:
    """An ARC file, version 1 or 2, as the equivalent WARC file."""
    return b"".join(warc_record(warc_fields(head, payload), payload) for head, payload in read_arc(data))


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and payload of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, size = end + 4, int(head["content-length"])
        if begin + size + 4 > len(data) or data[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield head, data[begin : begin + size]
        at = begin + size + 4


# --- tables -----------------------------------------------------------------------------------------------------------
def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def archive_pages(pages: DataFrame, path: str, version: int = 2) -> None:
    """Writes a WARC record for each row of ``pages(page_id, url, html)`` to gzipped archives under ``path``.

    Pages go through the legacy format: each is made a record of an ARC file, which the converter turns into a WARC
    record. Of records with equal payloads of at least REVISIT_BYTES that with the largest page_id keeps its payload; the
    others become revisit records, which have none and name it. Any other record is a response. The text writer
    of Spark writes the files, so they can go to any store; every record is valid UTF-8.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload_of(F.col("html")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = rows.filter(large).groupBy("sha1", F.octet_length("payload").alias("size")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("times"))
    groups = stage(groups.filter("times > 1 and last is not null").select(F.col("sha1").alias("same"), "size", "last"), "warc-groups")
    rows = rows.join(groups, large & (F.col("sha1") == F.col("same")) & (F.octet_length("payload") == F.col("size")), "left")
    rows = rows.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to"))

    def convert(batches):
        for batch in batches:
            out = []
            for page, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                name = "-" if page is None else f"page-{page}"
                arc = arc_version_block(version) + arc_record(version, payload, url, filename=name)
                (_, _), (head, body) = read_arc(arc)
                fields = dict(warc_fields(head, body)) | {"WARC-Type": "response", "X-Page-Id": "" if page is None else str(page), "X-Payload-Length": str(len(body))}
                if refers is not None:
                    fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers), "Content-Length": "0"}
                    body = b""
                out.append(warc_record(list(fields.items()), body)[:-2].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    records = rows.mapInArrow(convert, "value string")
    # a record ends with two line ends; the writer puts the second
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)``, one row for each record under ``path``."""
    import gzip

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, body in read_warc(gzip.decompress(content.as_py())):
                    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                    if head["warc-type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(head["x-payload-length"])):
                        raise ValueError("a payload doesn't match its digest")
                    number = lambda x: int(x) if x else None
                    rows.append((number(head["x-page-id"]), head.get("warc-target-uri"), int(head["x-payload-length"]), digest, head["warc-type"], number(head.get("x-refers-to-page"))))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archives back.

    One row per row of ``pages``. A null html is an empty payload, a null URL an empty one; equal payloads whose ids are
    all null don't refer to each other, and a row with a null id never refers. Rows that repeat the largest
    page_id are all responses. Other columns are ignored; an empty table gives an empty result.
    """
    path = new_path(pages.sparkSession, "warc")
    archive_pages(pages, path)
    return read_archives(pages.sparkSession, path)


def pages_table(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")

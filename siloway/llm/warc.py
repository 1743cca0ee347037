"""Converting legacy ARC archives to WARC, and reading both.

An ARC file starts with a version block that names the fields of the header line of every record after it; version 1
has five fields, version 2 ten. A record's last header field declares how many bytes follow. The converter reads the
version block, takes header lines apart by it, skips exactly the declared bytes, and builds the WARC record: an
identifier derived from the record's place, the 14-digit date as a W3C one, SHA-1 digests in base 32, and the type. Of
records with equal payloads the one with the smallest source id is a response and the others are revisits of it.

Archives are whole files of the shared folder, written by Spark's text writer with one archive as one row, so they are
written through the same committers and file systems as any table; Python code of a task sees one archive of bounded
size at a time. Records are bytes throughout, which need not be text in any charset: the writer takes them as they are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import new_path, table, written

#: Bytes after which an archive is closed; a single larger record still fills one archive.
ARCHIVE_BYTES = 8_000_000

#: Parts that the records of one payload are dealt to.
RUNS = 256

#: The date that records get where the input has none, and the address of an unknown host.
DATE, ADDRESS = "20200101000000", "0.0.0.0"

#: Fields of the header lines by version of the ARC format (fixed by the format).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}

#: What carries the source id of a row through an archive.
ID_HEADER = "X-Source-Id"

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: ``head`` is the HTTP head of the document as it stood, empty for documents of other protocols, which are all payload.
RECORD = "source_id long, url string, address string, mime string, date string, place string, head string, payload binary"
COLUMNS = [field.split(" ")[0] for field in RECORD.split(", ")]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def unpacked(content: bytes) -> bytes:
    """An archive's bytes, gzipped or not."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def safe_url(url: str | None) -> str:
    """A URL without white space or control characters, as a header line needs it; '-' if there is none."""
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~-._", errors="replace") if url else "-"


def http_head(source_id: int | None, mime: str, n_bytes: int) -> str:
    own = "" if source_id is None else f"{ID_HEADER}: {source_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n{own}Content-Length: {n_bytes}\r\n\r\n"


def head_field(head: str, name: str) -> str | None:
    """A field of an HTTP head or of WARC named fields; names are matched in any letter case."""
    for line in head.split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 siloway\n{' '.join(FIELDS[version])}\n"
    line = {"URL": f"filedesc://{name}", "Content-type": "text/plain", "Archive-length": len(body)} | {"IP-address": ADDRESS, "Archive-date": DATE}
    line |= {"Result-code": 200, "Filename": name, "Offset": 0}
    return (" ".join(str(line.get(f, "-")) for f in FIELDS[version]) + "\n" + body + "\n").encode()


def arc_record(version: int, name: str, source_id: int | None, url: str | None, html: str | bytes | None) -> bytes:
    """An ARC record: header line, network document, newline. Text is UTF-8, bytes stay what they are."""
    body = html.encode() if isinstance(html, str) else html or b""
    data = http_head(source_id, "text/html", len(body)).encode() + body
    line = {"URL": safe_url(url), "IP-address": ADDRESS, "Archive-date": DATE, "Content-type": "text/html", "Result-code": 200, "Filename": name}
    line |= {"Checksum": hashlib.md5(data).hexdigest(), "Archive-length": len(data)}
    return " ".join(str(line.get(f, "-")) for f in FIELDS[version]).encode() + b"\n" + data + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, network document) of the records of one ARC file, its version block left out."""
    if not data.strip():  # a part that no row was written to
        return
    end = data.index(b"\n")
    declared = int(data[:end].split(b" ")[-1])
    block = data[end + 1 : end + 1 + declared].decode("utf-8", "replace").split("\n")
    version, names = int(block[0].split(" ")[0]), block[1].split(" ")
    if version not in FIELDS or len(names) != len(FIELDS[version]):
        raise ValueError(f"not an ARC version block: {block[:2]}")
    at = end + 1 + declared
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        extra = len(values) - len(names)  # old crawlers left spaces in the URL
        if extra < 0:
            raise ValueError(f"short ARC header line at {at}")
        fields = dict(zip(names, [" ".join(values[: extra + 1]), *values[extra + 1 :]], strict=True))
        length = int(fields["Archive-length"])
        at = end + 1 + length
        if at > len(data):
            raise ValueError(f"ARC record cut short at {end}")
        yield fields, data[end + 1 : at]


def _packed(records: Iterator, make) -> Iterator[pa.RecordBatch]:
    """Records to archives of bounded size: make(name) gives (start of an archive, record -> bytes)."""
    held: list[bytes] = []
    size = 0
    start, record = make(f"part-{uuid.uuid4().hex}")
    for row in records:
        held.append(record(row))
        size += len(held[-1])
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([start + b"".join(held)], pa.binary())], ["value"])
            held, size = [], 0
            start, record = make(f"part-{uuid.uuid4().hex}")
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([start + b"".join(held)], pa.binary())], ["value"])


def _write(archives: DataFrame, what: str, end: str) -> str:
    """One file per row; ``end`` is the line end that readers of the format skip between records. The cast takes bytes as they are."""
    path = new_path(archives.sparkSession, what)
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(df: DataFrame, id_col: str, url_col: str, html_col: str, version: int = 1) -> str:
    """Write the rows as ARC files of a version; returns their folder. The html may be text, written in UTF-8, or bytes of any
    charset; null is an empty document, a null url '-'."""

    def make(name: str):
        return arc_version_block(version, name), lambda r: arc_record(version, name, *r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), u.as_py(), h.as_py()) for b in batches for i, u, h in zip(*b.columns, strict=True))
        return _packed(rows, make)

    rows = df.select(F.col(id_col).cast("long").alias("source_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return _write(rows.mapInArrow(run, "value binary"), f"arc{version}", "\n")


def records_of(file: str, content: bytes) -> Iterator[tuple]:
    """The records (RECORD's columns) of one ARC file. ``place`` is the file's name and the record's ordinal in it."""
    for i, (fields, document) in enumerate(arc_records(unpacked(content))):
        head, blank, payload = document.partition(b"\r\n\r\n") if document.startswith(b"HTTP/") else (b"", b"", document)
        head = (head + blank).decode("latin-1")
        own = head_field(head, ID_HEADER)
        yield None if own is None else int(own), fields["URL"], fields["IP-address"], fields["Content-type"], fields["Archive-date"], f"{file.rpartition('/')[2]}:{i}", head, payload


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files of either version. ``place`` is file and ordinal, unique in the folder."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield _frame([*records_of(file, content)], COLUMNS)

    return _files(spark, path).mapInPandas(parse, RECORD)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=columns, dtype=object)
    for c in ("source_id", "refers_to_id", "payload_bytes"):
        if c in made:
            made[c] = made[c].astype("Int64")
    return made


# --- WARC --------------------------------------------------------------------------------------------------------


def warc_id(place: str) -> str:
    """The identifier of the record that stood at a place of the legacy archives."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, place)}>"


def warc_date(date14: str) -> str:
    d = date14.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_info(name: str) -> bytes:
    """The record that a WARC file starts with."""
    body = "software: siloway\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", warc_id(name)), ("WARC-Date", warc_date(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + body + "\r\n\r\n").encode()


def warc_record(row: tuple, refers_to: str | None = None) -> bytes:
    """The WARC/1.1 record of a RECORD row: a response, or a resource where the document had no HTTP head. A revisit, of the record
    that stood at ``refers_to``, holds the head only; its declared digest is the full payload's. Heads, with the charset that
    they declare, and payloads are kept byte for byte."""
    _, url, address, mime, date, place, head, payload = row
    head = head.encode("latin-1")
    revisit = refers_to is not None
    block = head + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response" if head else "resource"),
        ("WARC-Record-ID", warc_id(place)),
        ("WARC-Date", warc_date(date)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response" if head else mime),
        ("Content-Length", str(len(block))),
    ]
    if address not in ("-", ADDRESS):
        fields.append(("WARC-IP-Address", address))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", warc_id(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(named fields, block) of the records of one WARC file; each block's length is the declared one."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        fields = data[at:end].decode("utf-8", "replace")
        if not fields.startswith("WARC/1."):
            raise ValueError(f"not a WARC record at {at}")
        length = int(head_field(fields, "Content-Length") or "")
        start, at = end + 4, end + 4 + length
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record with a wrong length at {end}")
        yield fields, data[start:at]
        at += 4


def convert(spark: SparkSession, path: str, min_bytes: int = 0) -> str:
    """Convert a folder of legacy archives to WARC files; returns their folder.

    Records whose payloads of at least ``min_bytes`` are equal (length, SHA-256 and a second 64-bit hash) are one class; the smallest
    (source id, place) of it is a response and the others revisit it. Smaller payloads are all responses, and documents
    without an HTTP head are all resources. Only the places travel with the digests. What they come to is gathered by archive,
    which a bounded number of records share, and the archives, as they lie in storage, are converted one by one.
    """
    run = F.pmod(F.xxhash64("place"), F.lit(RUNS)).cast("int").alias("run")
    small = written(
        read_arc(spark, path).select(
            "source_id", "place", "head", F.octet_length("payload").alias("n"), F.unhex(F.sha2("payload", 256)).alias("digest"), F.xxhash64("payload").alias("second"), run
        ).filter((F.col("n") >= min_bytes) & (F.col("head") != "")).drop("head"),
        "payload-digests",
    )
    # a payload of any number of copies is one entry per run, so no join gathers its records
    key = ["n", "digest", "second"]
    leaves = small.groupBy("run", *key).agg(F.min(F.struct(F.col("source_id").isNull(), "source_id", "place")).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = leaves.groupBy(*key).agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1")
    down = leaves.select("run", *key).join(first.select(*key, F.col("first.place").alias("refers_to")), key)
    again = small.join(down, ["run", *key]).filter("place <> refers_to").select("place", "refers_to")
    by_file = again.groupBy(F.substring_index("place", ":", 1).alias("file")).agg(F.collect_list(F.struct("place", "refers_to")).alias("again"))
    files = _files(spark, path).withColumn("file", F.substring_index("path", "/", -1)).join(written(by_file, "revisits"), "file", "left").select("path", "content", "again")

    def make(name: str):
        return warc_info(name), lambda r: warc_record(*r)

    def run_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, content, again in zip(*batch.columns, strict=True):
                    refers = {r["place"]: r["refers_to"] for r in again.as_py() or ()}
                    for record in records_of(file.as_py(), content.as_py()):
                        yield record, refers.get(record[5])

        return _packed(rows(), make)

    return _write(files.mapInArrow(run_files, "value binary"), "warc", "\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record: source_id, record_id, refers_to_record, record_type, url, payload_bytes, payload_digest.

    A response's payload is measured and its digest checked against the declared one; a revisit has only the declared.
    """
    columns = ["source_id", "record_id", "refers_to_record", "record_type", "url", "payload_bytes", "payload_digest"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for fields, block in warc_records(unpacked(content)):
                    kind = head_field(fields, "WARC-Type")
                    if kind == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
                    head = head.decode("latin-1")
                    digest = (head_field(fields, "WARC-Payload-Digest") or "").partition(":")[2]
                    length = len(payload)
                    if kind == "revisit":
                        length = int(head_field(head, "Content-Length") or 0)
                    elif sha1_base32(payload) != digest:
                        raise ValueError(f"payload digest differs: {fields}")
                    own = head_field(head, ID_HEADER)
                    rows.append((None if own is None else int(own), head_field(fields, "WARC-Record-ID"), head_field(fields, "WARC-Refers-To"), kind, head_field(fields, "WARC-Target-URI"), length, digest))
                yield _frame(rows, columns)

    return _files(spark, path).mapInPandas(
        parse, "source_id long, record_id string, refers_to_record string, record_type string, url string, payload_bytes long, payload_digest string"
    )


def archive_index(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Rows written as legacy archives, converted to WARC and read back, with ``refers_to`` resolved to a source id. The html may be
    text or bytes.

    One row per row of ``df``: source_id, url, payload_bytes, payload_digest, record_type, refers_to. Null html is an
    empty payload; null and empty payloads are equal to each other. Null ids sort last among equal payloads. Of repeated
    rows one is the response and the others revisit it. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    legacy = write_arc(df, id_col, url_col, html_col, version)
    found = written(read_warc(spark, convert(spark, legacy, min_bytes)), "warc-index")
    target = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("source_id").alias("refers_to"))
    run = F.pmod(F.xxhash64("record_id"), F.lit(RUNS)).cast("int")
    revisits = found.filter("record_type = 'revisit'").withColumn("run", run)
    resolved = revisits.select("run", "refers_to_record").distinct().join(target, "refers_to_record")
    revisits = revisits.join(resolved, ["run", "refers_to_record"], "left").drop("run")
    rest = found.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.unionByName(revisits).select("source_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives: size and digest of its payload, and whether it is a revisit."""
    return archive_index(table(spark, sf_dir, "pages")).select(
        F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 5))::BIGINT >> {shift}) & 31)::INTEGER + 1, 1)"

SQL = {
    "op6_warc": f"""
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages
), classed AS (
  SELECT *, min(page_id) OVER (PARTITION BY b) AS first_id FROM rows
)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  {" || ".join(_DIGIT.format(at=1 + 5 * (i // 4), shift=15 - 5 * (i % 4)) for i in range(32))} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM classed
""",
}

"""Operator 11, WARC: legacy ARC archives, versions 1 and 2, converted to WARC 1.1.

An ARC file starts with a version block, whose second line names the fields of the header lines that follow; a header line has
single spaces between fields and ends with the declared length of the content. Fields are taken from the right, so that a URL
may hold spaces. From each record follow a WARC record's id (a name-based UUID of the archive and the record's place, so that
a task that runs again gives the same one), timestamp, type and digests. Archives are read and written as streams, a record at
a time; a task converts an archive.

Equal payloads are found on (digest, bytes) alone, in a pass over the archives before the conversion: one record of a group is
the response, the others become revisits without payload. What a task needs of that is the list of its own archive's revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_table_path, slices, small_side, stored

#: An archive is closed at so many bytes of content; a longer record has one of its own.
ARCHIVE_BYTES = 64 << 20
GZIP_LEVEL = 4
NO_DATE, NO_IP, NO_URL = "19700101000000", "0.0.0.0", "unknown:"  # noqa: S104

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_ORIGIN = "InternetArchive"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP header that carries a page's id.
ID_HEADER = "X-Page-Id"


class ArcRecord(NamedTuple):
    version: int
    url: str
    ip: str
    date: str
    mime: str
    content: bytes


class WarcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, index: int) -> str:
    """The id of the record that an archive's record number `index` becomes; number 0 is its version block."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{index}')}"


def warc_date(date: str) -> str:
    """14 digits, or the first 4 or more of them, as an ISO timestamp; what is not a date counts as the epoch."""
    if not re.fullmatch(r"\d{4,14}", date):
        date = NO_DATE
    date += NO_DATE[len(date) :]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head, with its empty line, and payload of an HTTP response."""
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"\r\n" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head, re.IGNORECASE)
    return found[1].decode("utf-8", "replace").strip() if found else None


def arc_records(stream: BinaryIO, name: str) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block. Raises ValueError on a header line or a length that doesn't hold."""
    names, version, index = ARC_FIELDS[1].split(" "), 1, 0
    while True:
        line = stream.readline()
        if not line:
            return
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        # The version block's own line may have the fields of either version; its length is the last one in both.
        values = line.decode("utf-8", "surrogateescape").rsplit(" ", len(names) - 1)
        if index == 0 and not line.startswith(b"filedesc://"):
            raise ValueError(f"{name}: no version block")
        if len(values) < len(names) or not values[-1].isdigit():
            raise ValueError(f"{name}: record {index}: bad header line {line[:200]!r}")
        content = stream.read(int(values[-1]))
        if len(content) < int(values[-1]):
            raise ValueError(f"{name}: record {index}: {len(content)} bytes of {values[-1]}")
        if index == 0:
            first, _, rest = content.decode("utf-8", "replace").partition("\n")
            if not first[:1].isdigit() or int(first.split(" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"{name}: unknown version {first[:40]!r}")
            version = int(first.split(" ")[0])
            names = (rest.split("\n")[0].strip() or ARC_FIELDS[version]).split(" ")
        else:
            row = dict(zip(names, values, strict=True))
            yield ArcRecord(version, row["URL"], row.get("IP-address", NO_IP), row.get("Archive-date", NO_DATE), row.get("Content-type", ""), content)
        index += 1


def arc_version_block(version: int, name: str) -> bytes:
    block = f"{version} 0 {ARC_ORIGIN}\n{ARC_FIELDS[version]}\n\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": NO_IP, "Archive-date": NO_DATE, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[x] for x in ARC_FIELDS[version].split(" ")).encode() + b"\n" + block + b"\n"


def arc_entry(version: int, name: str, url: bytes, date: str, mime: str, content: bytes) -> bytes:
    values = {"IP-address": NO_IP, "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(content))}
    safe = re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url) or NO_URL.encode()
    return safe + "".join(f" {values[x]}" for x in ARC_FIELDS[version].split(" ")[1:]).encode() + b"\n" + content + b"\n"


def warc_bytes(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warc_records(stream: BinaryIO, name: str) -> Iterator[WarcRecord]:
    """The records of a WARC file; field names in lower case. Raises ValueError on what is no record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at {line[:80]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{name}: {len(block)} bytes of {size}")
        yield WarcRecord(fields, block)


def from_arc(record: ArcRecord, archive: str, index: int, revisit: dict | None) -> tuple[dict[str, str], bytes]:
    """Fields and block of the WARC record for an ARC record; as a revisit where the record that it repeats is given."""
    is_http = record.content.startswith(b"HTTP/")
    head, payload = http_parts(record.content) if is_http else (b"", record.content)
    block = head if revisit else record.content
    fields = {
        "WARC-Type": "revisit" if revisit else "response" if is_http else "resource",
        "WARC-Record-ID": f"<{record_id(archive, index)}>",
        "WARC-Warcinfo-ID": f"<{record_id(archive, 0)}>",
        "WARC-Date": warc_date(record.date),
        "WARC-Target-URI": record.url,
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response" if is_http else record.mime or "application/octet-stream",
    }
    if record.ip != NO_IP:
        fields["WARC-IP-Address"] = record.ip
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record_id(revisit['arc'], revisit['index'])}>", "WARC-Refers-To-Target-URI": revisit["url"], "WARC-Refers-To-Date": warc_date(revisit["date"])}
    return fields, block


def _uri(folder: str) -> str:
    if "://" in folder:
        return folder
    return folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"


class Archive:
    """A file of gzip members that gets its name when it is closed, so that a task that runs again leaves the same file."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.path, self.draft = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.draft)
        self.records = 0

    def write(self, data: bytes) -> None:
        self.out.write(gzip.compress(data, GZIP_LEVEL, mtime=0))
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)


def _opened(uri: str) -> BinaryIO:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    stream = store.open_input_stream(path, compression=None, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream


def write_arcs(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page as an HTTP response in ARC files and returns (arc, records): each file's URI and number of records.

    Tasks write versions 1 and 2 in turn. Null payload is empty, null URL is `unknown:`, bytes of a URL outside visible ASCII
    are percent-encoded, and a null id leaves its header out. A task writes its own archives, and nothing is moved.
    """
    folder = _uri(folder or new_table_path(pages.sparkSession, "arc"))

    def run(batches):
        part, number, open_one, size = TaskContext.get().partitionId(), 0, None, 0
        finished = []
        for batch in slices(batches, 64):
            for key, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_one is None:
                    version = 1 + (part + number) % 2
                    name = f"pages-{part:06d}-{number:04d}-v{version}.arc.gz"
                    open_one, size = Archive(folder, name), 0
                    open_one.write(arc_version_block(version, name))
                own = f"{ID_HEADER}: {key}\r\n" if key is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()
                open_one.write(arc_entry(version, name, url or b"", NO_DATE, "text/html", head + payload))
                size += len(payload)
                if size >= archive_bytes:
                    open_one.close()
                    finished.append((name, open_one.records - 1))
                    open_one, number = None, number + 1
        if open_one is not None:
            open_one.close()
            finished.append((name, open_one.records - 1))
        if finished:
            names, records = zip(*finished, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array(records, pa.int64())], ["arc", "records"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("binary").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    return stored(rows.mapInArrow(run, "arc string, records long"), "arcs")


def _spread(archives: DataFrame) -> DataFrame:
    """A row an archive, dealt so that tasks hold few each, whatever the size of the rows."""
    return archives.repartition(max(1, archives.count()))


def _rows_of(archives: DataFrame, schema: str, rows_of) -> DataFrame:
    """rows_of(uri) of each archive, (uri) the first column, as tuples in the schema's order."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for row in rows_of(uri):
                    rows.append(row)
                    if len(rows) >= 2048:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return archives.mapInArrow(run, schema)


PAYLOADS = "arc string, index int, key long, url string, date string, bytes long, digest string"


def arc_payloads(arcs: DataFrame) -> DataFrame:
    """PAYLOADS: what identifies each HTTP response of the archives and its payload. arcs: a column arc of URIs."""

    def rows_of(uri):
        name = uri.rsplit("/", 1)[1]
        with _opened(uri) as stream:
            for index, record in enumerate(arc_records(stream, name), 1):
                if record.content.startswith(b"HTTP/"):
                    head, payload = http_parts(record.content)
                    key = http_field(head, ID_HEADER)
                    yield name, index, int(key) if key is not None else None, record.url, record.date, len(payload), base32_sha1(payload)

    return _rows_of(_spread(arcs.select("arc")), PAYLOADS, rows_of)


def revisits_of(payloads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(arc, revisits): for each archive with any, its records that repeat another's payload of at least so many bytes, each
    with the record it repeats, the one with the largest key of all that are equal (null is smallest, then the last in order
    of archive and place)."""
    order = F.struct(F.col("key").isNotNull().alias("known"), "key", "arc", "index", "url", "date")
    groups = payloads.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max(order).alias("original")).filter("n > 1")
    groups = stored(groups.select("digest", "bytes", F.struct("original.arc", "original.index", "original.url", "original.date").alias("original")), "equal")
    again = payloads.join(small_side(groups), ["digest", "bytes"]).filter(~((F.col("arc") == F.col("original.arc")) & (F.col("index") == F.col("original.index"))))
    return again.groupBy("arc").agg(F.collect_list(F.struct("index", "original")).alias("revisits"))  # an archive's records, at most


def convert_arcs(arcs: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Converts ARC files to WARC files, one for one, and returns (warc, records). arcs: a column arc of URIs.

    HTTP responses with equal payloads of at least `least_bytes` bytes: one stays a response, the others become revisits with
    their HTTP head. Other records become resources. An ARC that breaks off or has a bad header line fails the job by its name
    and the record's place. Repeated URIs are converted once.
    """
    folder = _uri(folder or new_table_path(arcs.sparkSession, "warc"))
    arcs = arcs.select("arc").distinct()
    payloads = stored(arc_payloads(arcs), "payloads")
    lists = revisits_of(payloads, least_bytes).withColumnRenamed("arc", "name")
    work = arcs.withColumn("name", F.element_at(F.split("arc", "/"), -1)).join(lists, "name", "left").select("arc", "revisits")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                uri, revisits = batch.column(0)[i].as_py(), {x["index"]: x["original"] for x in batch.column(1)[i].as_py() or []}
                name = uri.rsplit("/", 1)[1]
                warc = Archive(folder, re.sub(r"(\.arc)?(\.gz)?$", "", name, count=1) + ".warc.gz")
                info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_id(name, 0)}>", "WARC-Date": warc_date(NO_DATE), "WARC-Filename": warc.path.rsplit("/", 1)[1], "Content-Type": "application/warc-fields"}
                warc.write(warc_bytes(info, f"format: WARC File Format 1.1\r\nsource: {name}\r\n".encode()))
                with _opened(uri) as stream:
                    for index, record in enumerate(arc_records(stream, name), 1):
                        warc.write(warc_bytes(*from_arc(record, name, index, revisits.get(index))))
                warc.close()
                out = f"{folder}/{warc.path.rsplit('/', 1)[1]}"
                yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([warc.records - 1], pa.int64())], ["warc", "records"])

    work = stored(work, "work")  # so that the row count below costs nothing
    return stored(_spread(work).mapInArrow(run, "warc string, records long"), "warcs")


RECORDS = "record_id string, record_type string, url string, date string, key long, payload_bytes long, payload_digest string, refers_to_id string"


def read_warcs(warcs: DataFrame) -> DataFrame:
    """RECORDS of WARC files but for warcinfo, with every digest checked against its bytes. warcs: a column warc of URIs. A
    revisit's payload_bytes are those that its HTTP head declares."""

    def rows_of(uri):
        with _opened(uri) as stream:
            for fields, block in warc_records(stream, uri):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = http_parts(block) if block.startswith(b"HTTP/") else (b"", block)
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                if fields.get("warc-block-digest", "") != f"sha1:{base32_sha1(block)}" or (kind != "revisit" and digest != base32_sha1(payload)):
                    raise ValueError(f"{uri}: {fields['warc-record-id']} doesn't have its digest")
                key, size = http_field(head, ID_HEADER), len(payload)
                if kind == "revisit":
                    size = int(http_field(head, "Content-Length") or 0)
                refers = fields.get("warc-refers-to")
                yield fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), int(key) if key is not None else None, size, digest, refers and refers.strip("<>")

    return _rows_of(_spread(warcs.select("warc")), RECORDS, rows_of)


def archive_pages(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages as legacy ARC files, converts these to WARC files and reads them back: one row per page with its id,
    payload_bytes, payload_digest, record_type (response or revisit), refers_to (id of the page that a revisit repeats), and
    url, date, record_id and refers_to_id as in the archive.

    Null payloads are empty and equal to one another; null ids are kept and are smallest; of repeated rows with one id one
    is the response; an empty table gives no rows; other columns are ignored whatever their names are.
    """
    arcs = write_arcs(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, archive_bytes=archive_bytes)
    records = stored(read_warcs(convert_arcs(arcs, least_bytes=least_bytes)), "records")
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    again = records.filter("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    first = records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    out = first.unionByName(again)
    return out.select(F.col("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id", "refers_to_id")

"""WARC archives as a PySpark Python data source: planned splits, pushed filters, headers first, payloads on demand."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from verdigris.llm.common import free_name, open_fs, quoted, stored

COLUMNS = "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Bytes of an archive from which a reader's split is closed.
SPLIT_BYTES = 16 << 20
#: Bytes of an archive from which the writer starts another.
FILE_BYTES = 256 << 20
#: One file per commit; together they list what readers see.
MANIFEST = "_manifest-"
#: Says that the target URI is escaped as in a JSON string, so that any text survives a header line.
ESCAPED = "x-target-uri-escaping"
BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20
#: Where a field of a row stands in a record's header.
HEADER_OF = {"record_type": "warc-type", "page_id": "x-page-id", "url": "warc-target-uri", "payload_bytes": "x-payload-length", "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-page"}
NUMBERS = ("page_id", "payload_bytes", "refers_to")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(head: bytes, body: bytes) -> bytes:
    """One gzip member whose extra field SL holds its own length, so that a reader can step over it uninflated."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    data = packer.compress(head) + packer.flush(zlib.Z_FULL_FLUSH) + packer.compress(body) + packer.flush()
    size = 10 + 2 + 8 + len(data) + 8
    whole = head + body
    extra = b"SL" + struct.pack("<HI", 4, size)
    return b"\x1f\x8b\x08\x04" + struct.pack("<I", 0) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A response record with its payload, or a revisit record without; both carry length and digest of the full payload."""
    body = (row["payload"] or b"") if row["record_type"] == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"Content-Length: {len(body)}", "Content-Type: text/html", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        lines += ["WARC-Target-URI: " + json.dumps(row["url"])[1:-1].replace(" ", "\\u0020"), "X-Target-URI-Escaping: json"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page: {row['refers_to']}")
    return member(("\r\n".join(lines) + "\r\n\r\n").encode(), body + b"\r\n\r\n")


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task writes archives under names of its own attempt; only those that the commit lists exist for readers."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files: list = []
        out, size, split = None, 0, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        name, size, split = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        files.append({"name": name, "splits": [0]})
                    data = record(row)
                    if size - split >= SPLIT_BYTES:
                        split = size
                        files[-1]["splits"].append(size)
                    out.write(data)
                    size += len(data)
                    files[-1]["size"] = size
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        """Adds a manifest of this write's archives to those of earlier ones; it appears whole or not at all."""
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{MANIFEST}{uuid.uuid4().hex}.json"
        with fs.open_output_stream(name + ".part", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        fs.move(name + ".part", name)

    def abort(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/{f['name']}")


@dataclass
class Split(InputPartition):
    name: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    """Splits at record starts that the manifest lists (a foreign archive is one split); filters on header fields are pushed."""

    def __init__(self, path: str, payload: bool, verify: bool) -> None:
        self.path, self.payload, self.verify, self.wanted = path, payload, verify, []

    def pushFilters(self, filters: list) -> Iterator:
        """Equality, IN and IS NOT NULL on header fields are taken from Spark, which evaluates the others."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if name in HEADER_OF and (isinstance(f, IsNotNull) or (values is not None and None not in values)):
                self.wanted.append((name, values))
            else:
                yield f

    def partitions(self) -> list[Split]:
        fs, root = open_fs(self.path)
        found = [i for i in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file]
        names = {i.path: i.path[i.path.index(root.lstrip("/")) + len(root.lstrip("/")) :].lstrip("/") for i in found}
        files: list[dict] = []
        listed = sorted(i.path for i in found if names[i.path].startswith(MANIFEST) and i.path.endswith(".json"))
        for path in listed:
            with fs.open_input_stream(path) as src:
                files += json.loads(src.read())
        if not listed:
            files = [{"name": names[i.path], "splits": [0], "size": i.size} for i in found if i.path.endswith((".warc.gz", ".warc"))]
        return [Split(f["name"], a, b) for f in files for a, b in zip(f["splits"], [*f["splits"][1:], f["size"]], strict=True)]

    def fits(self, head: dict) -> bool:
        """Decoded values are compared, as Spark would compare the rows."""
        told = ((values, field_of(head, name)) for name, values in self.wanted)
        return all(value is not None and (values is None or value in values) for values, value in told)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split is None:
            return
        fs, root = open_fs(self.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(f"{root}/{split.name}") as src:
            for head, body in records(src, split.start, split.end, self.fits, self.payload or self.verify):
                payload = None
                if body is not None and head.get("warc-type") != "revisit":
                    kind, _, digest = head.get("warc-payload-digest", "").rpartition(":")
                    if self.verify and digest and kind in ("", "sha1") and digest_of(body) != digest:
                        raise ValueError(f"{split.name}: a payload doesn't match its digest")
                    payload = body if self.payload else None
                rows.append({name: field_of(head, name) for name in HEADER_OF} | {"payload": payload})
                held += len(payload or "")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def field_of(head: dict[str, str], name: str) -> object:
    """A row's field from a record's headers; null where a header is missing or, in foreign archives, no number."""
    value = head.get(HEADER_OF[name])
    if value is None:
        return None
    if name in NUMBERS:
        return int(value) if value.lstrip("-").isdecimal() else None
    if name == "url" and ESCAPED in head:
        return json.loads(f'"{value}"')
    return value.removeprefix("sha1:") if name == "payload_digest" else value


SCHEMA = pa.schema([*((n, pa.int64() if n in NUMBERS else pa.string()) for n in HEADER_OF), ("payload", pa.binary())])


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode(errors="replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}


def records(src, start: int, end: int, fits, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, body or None) of the records in [start, end) that fit; bodies of others, or unwanted, stay undecoded."""
    window, first = b"", 0

    def get(at: int, n: int) -> bytes:
        """Up to n bytes from at on; what lies between two calls isn't read unless it's near."""
        nonlocal window, first
        n = min(n, end - at)
        if at < first or at + n > first + len(window):
            src.seek(at)
            window, first = src.read(min(max(n, 1 << 20), end - at)), at
        return window[at - first : at - first + n]

    at = start
    while at < end:
        lead = get(at, 12)
        if lead[:2] != b"\x1f\x8b":
            n = 4096
            while (close := (text := get(at, n)).find(b"\r\n\r\n")) < 0:
                if n >= end - at:
                    return  # trailing white space
                n *= 4
            head = headers(text[:close])
            length = int(head.get("content-length", 0))
            if fits(head):
                yield head, get(at + close + 4, length) if payloads else None
            at += close + 4 + length + 4
            continue
        size, body_at = None, at + 10
        if lead[3] & 4:
            n = struct.unpack_from("<H", lead, 10)[0]
            field, body_at = get(at + 12, n), at + 12 + n
            while len(field) >= 4:
                n = struct.unpack_from("<H", field, 2)[0]
                if field[:2] == b"SL":
                    size = struct.unpack_from("<I", field, 4)[0]
                field = field[4 + n :]
        for flag in (8, 16):  # name and comment, in foreign archives
            if lead[3] & flag:
                body_at += get(body_at, 4096).index(b"\0") + 1
        if lead[3] & 2:
            body_at += 2
        unpack, fed, text = zlib.decompressobj(-15), body_at, b""
        while b"\r\n\r\n" not in text and not unpack.eof:
            if not (more := get(fed, 1024)):
                raise ValueError("an archive ends inside a header")
            text += unpack.decompress(more)
            fed += len(more)
        raw, _, rest = text.partition(b"\r\n\r\n")
        head = headers(raw)
        wanted, body = fits(head), None
        if size is None or (wanted and payloads):
            parts = [rest]
            while not unpack.eof:
                if not (more := get(fed, 1 << 16 if size is None else max(1, at + size - fed))):
                    raise ValueError("an archive ends inside a record")
                parts.append(unpack.decompress(more))
                fed += len(more)
            body = b"".join(parts)[: int(head.get("content-length", 0))]
            if size is None:
                size = fed - len(unpack.unused_data) + 8 - at
        if wanted:
            yield head, body if payloads else None
        at += size


class WarcSource(DataSource):
    """format("warc"): options path, payload (decode payloads, default true), verify (hold payloads against digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        on = lambda key, default: self.options.get(key, default).lower() == "true"
        return WarcReader(self.options["path"], on("payload", "true"), on("verify", "false"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(digest: F.Column) -> F.Column:
    """RFC 4648 base32 of a 40-digit hexadecimal string: eight times five digits (20 bits) to four characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    value = lambda i: F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
    return F.concat(*[F.substring(alphabet, F.shiftright(value(i), 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for j in range(4)])


def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows for the writer (COLUMNS): of equal payloads of least_bytes or more the smallest page_id is response, others revisit it.

    Null html is an empty payload. Rows that repeat the smallest page_id are all responses; null ids come after all
    others and make a response only where no row of the payload has an id. Payloads are compared by SHA-1 and length. Only
    digests that occur twice or more are joined, by a plain equi-join. They're written first, so that Spark knows their
    size: where they're few it broadcasts them and the pages aren't shuffled; else it splits hot digests.
    """
    (first, seen) = free_name(pages, "_first", "_seen")
    payload = F.coalesce(quoted(html), F.lit(""))
    rows = pages.select(quoted(page_id).cast("long").alias("page_id"), quoted(url).alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("_hex"), payload.cast("binary").alias("payload"))
    groups = stored(rows.where(F.col("payload_bytes") >= least_bytes).groupBy("_hex", "payload_bytes").agg(F.min("page_id").alias(first), F.count("*").alias(seen)).where(F.col(seen) > 1), "digests")
    met = rows.join(groups, ["_hex", "payload_bytes"], "left")
    again = F.col(first).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(first))
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "url", "payload_bytes", base32(F.col("_hex")).alias("payload_digest"),
        F.when(again, F.col(first)).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, **columns: object) -> None:
    """Archives of pages under path, which executors and driver share."""
    register(pages.sparkSession)
    revisits(pages, **columns).write.format("warc").mode("append").option("path", path).save()


def read_warc(spark, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records under path. Filters on record_type and other header fields reach the reader; payload=False decodes none.

    Archives of several writes add up. Foreign archives (no manifest) are read too: page_id, payload_bytes and refers_to
    are then null. Payloads are bytes, whatever their encoding; verify holds those that have a SHA-1 digest against it.

    Every record has a type, so the filter here keeps all; but a query without any filter would make Spark take the
    filters that an earlier query of the same DataFrame has pushed.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path).where("record_type is not null")

"""WARC records in ZIP packages, read in place.

A package is a ZIP archive whose members are stored as they are, not deflated: a WARC
file of gzipped records and an index of their places. A reader needs the end of the file
for the directory, the index member, and then one range per record.
"""

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from querylume.llm.common import open_store, shared_folder, written

MIN_REVISIT_BYTES = 100
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 32 << 20

# Fixed values of the ZIP format: signatures, record layouts, the ZIP64 extra field.
END_OF_DIRECTORY, END_SIZE = b"PK\x05\x06", 22
END64_LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, ENTRY, LOCAL = b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
LONGEST_COMMENT = 65535
ZIP64_EXTRA = 1
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class StoredZip:
    """The directory of a ZIP archive, ZIP64 or not, over anything that can seek and
    read. ``members`` maps names to (start of the data, size) of stored members."""

    def __init__(self, file, size):
        self.file, self.size = file, size
        self.members = dict(self._members())

    def read(self, start, n):
        self.file.seek(start)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the archive ends early")
        return data

    def _directory(self):
        n = min(self.size, END_SIZE + LONGEST_COMMENT)
        tail = self.read(self.size - n, n)
        at = tail.rfind(END_OF_DIRECTORY)
        # The signature may stand in the comment too: the record's own comment ends the file.
        while at >= 0 and (n - at < END_SIZE or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != n):
            at = tail.rfind(END_OF_DIRECTORY, 0, at)
        if at < 0:
            raise ValueError("not a ZIP archive: it has no end-of-directory record")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == count or FULL32 in (length, start):
            where = self.size - n + at - LOCATOR_SIZE
            signature, _, end64 = struct.unpack_from("<4sIQ", self.read(where, LOCATOR_SIZE))
            if signature != END64_LOCATOR:
                raise ValueError("the ZIP64 locator is missing")
            head = self.read(end64, 56)
            if head[:4] != END64:
                raise ValueError("the ZIP64 end-of-directory record is missing")
            count, length, start = struct.unpack_from("<QQQ", head, 32)
        return count, self.read(start, length)

    def _members(self):
        count, data = self._directory()
        at = 0
        for _ in range(count):
            if data[at:at + 4] != ENTRY:
                raise ValueError("the directory is damaged")
            method = struct.unpack_from("<H", data, at + 10)[0]
            packed, size, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46:at + 46 + name_n].decode()
            extra = data[at + 46 + name_n:at + 46 + name_n + extra_n]
            size, packed, header = self._wide(extra, size, packed, header)
            at += 46 + name_n + extra_n + note_n
            if method == 0:
                yield name, (self._data_start(header), packed)

    @staticmethod
    def _wide(extra, *values):
        """The values with those that are full replaced from the ZIP64 extra field,
        which holds just these, in this order."""
        wide, at = b"", 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == ZIP64_EXTRA:
                wide = extra[at + 4:at + 4 + n]
            at += 4 + n
        given = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[:len(wide) // 8 * 8]))
        return [next(given) if v == FULL32 else v for v in values]

    def _data_start(self, header):
        local = self.read(header, 30)
        if local[:4] != LOCAL:
            raise ValueError("a member's own header is missing")
        name_n, extra_n = struct.unpack_from("<HH", local, 26)
        return header + 30 + name_n + extra_n


def _urn(page_id):
    return f"<urn:page:{page_id}>"


def _page_id(urn):
    text = re.fullmatch(r"<urn:page:(.*)>", urn)[1]
    return None if text == "None" else int(text)


def _safe(url):
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def warc_record(page_id, url, payload, digest, n_bytes, refers_to) -> bytes:
    """One record, gzipped. A revisit keeps the HTTP head, with the length of the payload
    it leaves out."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {n_bytes}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, compresslevel=3, mtime=0)


def parse_record(data: bytes):
    """Headers (lower-case names), HTTP headers and payload of one gzipped record."""
    record = gzip.decompress(data)
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    _, *lines = http.decode("latin-1").split("\r\n")
    return headers, {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}, payload


def _packing(folder):
    def pack(batches):
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, path = open_store(folder)
                    store.create_dir(path)
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{path}/{name}")
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    member = package.open(ARCHIVE, "w", force_zip64=True)
                    index, offset = io.BytesIO(), 0
                payload = (row["html"] or "").encode()
                data = warc_record(row["page_id"], row["url"], payload, row["digest"],
                                   row["n_bytes"], row["refers_to"])
                member.write(data)
                index.write(json.dumps(
                    {"id": row["page_id"], "offset": offset, "length": len(data)}
                ).encode() + b"\n")
                offset += len(data)
        if out is not None:
            member.close()
            package.writestr(INDEX, index.getvalue())
            package.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})
    return pack


def write_packages(pages: DataFrame, min_bytes=MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html; more columns are ignored) as packages; returns
    the written list of their paths.

    Among equal payloads of at least ``min_bytes`` the one with the smallest page_id is
    kept, the others are revisits of it. Rows that repeat that page_id are kept too, as are
    rows without a page_id in a group that has none. A null html is empty, a
    null url leaves its header out. No rows, no packages.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    sized = pages.select(
        "page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("n_bytes"),
    )
    first = (
        sized.filter(F.col("n_bytes") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").drop("n")
    )
    kept = sized.join(first, "digest", "left").withColumn(
        "refers_to", F.expr("CASE WHEN page_id = first THEN NULL ELSE first END"))
    return written(kept.drop("first").mapInArrow(_packing(folder), "path string"), "packages")


def _listing(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = open_store(path)
            with store.open_input_file(inner) as file:
                package = StoredZip(file, file.size())
                start, _ = package.members[ARCHIVE]
                entries = [json.loads(x) for x in package.read(*package.members[INDEX]).splitlines()]
            yield pa.RecordBatch.from_pydict({
                "path": [path] * len(entries),
                "start": pa.array([start + e["offset"] for e in entries], pa.int64()),
                "length": pa.array([e["length"] for e in entries], pa.int64()),
            })


def _reading(with_payload):
    schema = READ_ARROW if with_payload else READ_ARROW.remove(READ_ARROW.get_field_index("payload"))

    def read(batches):
        for batch in batches:
            store = file = opened = None
            rows, held = [], 0
            for path, start, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != opened:
                    store, inner = open_store(path)
                    file, opened = store.open_input_file(inner), path
                file.seek(start)
                headers, http, payload = parse_record(file.read(length))
                revisit = headers["warc-type"] == "revisit"
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                row = {
                    "page_id": _page_id(headers["warc-record-id"]),
                    "url": headers.get("warc-target-uri"),
                    "payload_bytes": int(http["content-length"]) if revisit else len(payload),
                    "payload_digest": digest, "record_type": headers["warc-type"],
                    "refers_to": _page_id(headers["warc-refers-to"]) if revisit else None,
                }
                if with_payload:
                    row["payload"] = None if revisit else payload
                    held += len(payload)
                rows.append(row)
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return read


# Payloads that one batch of records holds.
READ_BYTES = 8 << 20
READ = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long"
)
READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def read_packages(packages: DataFrame, payload=True) -> DataFrame:
    """Records of packages (path): page_id, url, payload (null for revisits, which hold
    none; only if asked for), payload_bytes and payload_digest of the full payload,
    record_type, refers_to.

    Directories and indexes give the place of every record; ranges of a large package
    are read by several tasks, a batch of about READ_BYTES of payloads at a time. A payload
    that does not match its digest is an error.
    """
    records = packages.repartition("path").mapInArrow(
        _listing, "path string, start long, length long")
    spread = records.repartition("path", F.expr(f"start div {SPLIT_BYTES}"))
    schema = READ if payload else READ.replace(" payload binary,", "")
    return spread.sortWithinPartitions("path", "start").mapInArrow(_reading(payload), schema)

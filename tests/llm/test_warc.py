import hashlib
import io
import struct
import zipfile

import pytest

from querylume.llm import warc
from querylume.llm.warc import StoredZip

PAGES = "page_id long, url string, html string, payload binary, digest string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, b"", "", "") for i, u, h in rows], PAGES)


def test_round_trip(spark):
    long = "<p>é" + "x" * 200
    rows = [
        (4, "http://a/", long), (2, "http://b/\r\nX: y", long), (9, None, long), (7, "u", "y" * 99), (8, "u", "y" * 99),
        (5, "u", "z" * 100), (6, "u", "z" * 100), (1, "u", None), (3, "u", ""), (10, "u", "a\r\n\r\nb" * 50000),
        (None, "u", "n" * 150), (None, "u", "n" * 150), (11, "u", "r" * 120), (11, "u", "r" * 120),
    ]
    got = warc.read_packages(warc.write_packages(pages(spark, rows))).collect()
    firsts = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            firsts[h] = min(i, firsts.get(h, i))
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        first = firsts.get(h) if sum(x[2] == h for x in rows) > 1 else None
        refers = None if first is None or first == i else first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(),
                     "revisit" if refers is not None else "response", refers,
                     None if refers is not None else data))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
              None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {r.page_id: r.url for r in got}[2] == "http://b/%0D%0AX:%20y"
    assert {r.page_id: r.url for r in got}[9] is None


def test_no_pages(spark):
    assert warc.read_packages(warc.write_packages(pages(spark, []))).collect() == []


def zipped(stored, deflated=(), comment=b"", prefix=b""):
    out = io.BytesIO()
    out.write(prefix)
    with zipfile.ZipFile(out, "a" if prefix else "w") as package:
        for name, data in stored:
            with package.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(data)
        for name, data in deflated:
            package.writestr(name, data, zipfile.ZIP_DEFLATED)
        package.comment = comment
    return out.getvalue()


def members(data):
    package = StoredZip(io.BytesIO(data), len(data))
    return {n: package.read(*at) for n, at in package.members.items()}


def test_directory():
    data = zipped([("a", b"one"), ("é/b", b""), ("c", b"x" * 5000)], [("d", b"y" * 999)], b"PK\x05\x06 in a comment")
    assert members(data) == {"a": b"one", "é/b": b"", "c": b"x" * 5000}
    assert members(zipped([])) == {}


def test_zip64_records():
    """The same archive with its directory's place and sizes only in ZIP64 records."""
    plain = zipped([("first", b"1" * 40), ("second", b"22")])
    end = plain.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", plain, end + 10)
    entries, directory, at = [], plain[start:start + length], 0
    for _ in range(count):
        name_n, extra_n, note_n = struct.unpack_from("<HHH", directory, at + 28)
        size = 46 + name_n + extra_n + note_n
        head = bytearray(directory[at:at + 46])
        packed, full, offset = *struct.unpack_from("<II", head, 20), struct.unpack_from("<I", head, 42)[0]
        struct.pack_into("<II", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        extra = struct.pack("<HHI", 0x7075, 4, 0) + struct.pack("<HHQQQ", 1, 24, full, packed, offset)
        struct.pack_into("<HH", head, 30, len(extra), 0)
        entries.append(bytes(head) + directory[at + 46:at + 46 + name_n] + extra)
        at += size
    wide = b"".join(entries)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(wide), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(wide), 1)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = plain[:start] + wide + end64 + locator + last
    assert members(data) == {"first": b"1" * 40, "second": b"22"}
    with pytest.raises(ValueError):
        members(plain[:start] + wide + end64 + last)


def test_what_is_no_archive():
    for data in (b"", b"PK", b"no archive at all" * 10):
        with pytest.raises(ValueError):
            members(data)


def test_batches_are_bounded_by_bytes_and_payloads_left_out(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{i} " * 400) for i in range(60)], "page_id long, url string, html string")
    packages = warc.write_packages(pages)
    whole = sorted(map(tuple, warc.read_packages(packages).collect()))
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    assert sorted(map(tuple, warc.read_packages(packages).collect())) == whole
    bare = warc.read_packages(packages, payload=False)
    assert "payload" not in bare.columns
    assert sorted(map(tuple, bare.collect())) == [w[:2] + w[3:] for w in whole]
    index = packages.mapInArrow(warc._listing, "path string, start long, length long").toPandas()
    import pyarrow as pa
    batch = pa.RecordBatch.from_pandas(index, preserve_index=False)
    assert len(list(warc._reading(True)([batch]))) > 20 and len(list(warc._reading(False)([batch]))) == 1

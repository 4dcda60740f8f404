"""Formats by bytes against files that the standard library writes."""

import gzip
import io
import json
import os
import tempfile
import zipfile

from lodestack.functions.file_bytes import format_of, gz_payload, zip_directory
from lodestack.sources.files import SAMPLE, sniff_files


def whole(data):
    return format_of(data[:SAMPLE], data[-SAMPLE:], len(data))


def zipped(names, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, "x" * 1000)
        z.comment = comment
    return out.getvalue()


def test_zip_headers_and_directories():
    data = zipped(["a.csv", "b/c.txt"], b"PK\x05\x06 in a comment")
    assert whole(data) == "ZIP" and zip_directory(data, len(data)) == 2
    assert whole(zipped([])) == "ZIP"
    assert whole(data[:-30]) == "UNKNOWN" and whole(b"PK\x03\x04" + bytes(40)) == "UNKNOWN"
    big = zipped([f"{i}" for i in range(3000)])
    assert len(big) > 2 * SAMPLE and whole(big) == "ZIP"


def test_gz_headers_with_all_parts():
    body = gzip.compress(b"a,b\n1,2\n")
    assert whole(body) == "GZ" and gz_payload(body) == 10
    full = body[:3] + bytes([4 | 8 | 16 | 2]) + body[4:10] + b"\x03\x00xyz" + b"name\0" + b"note\0" + b"\0\0" + body[10:]
    assert gz_payload(full) == 10 + 5 + 5 + 5 + 2 and whole(full) == "GZ"
    for cut in range(gz_payload(full) + 1):
        assert gz_payload(full[:cut]) == -1, cut
    assert whole(body[:3] + b"\x80" + body[4:]) == "UNKNOWN"


def test_texts():
    cases = {"a,b\n1,2\n": "CSV", "a;b\n1;2\n": "CSV", "a\tb\n1\t2\n": "TSV", '{"a": 1}': "JSON", '{"a":1}\n{"a":2}\n': "JSON", "[1, 2": "UNKNOWN", "a,b\n1\n": "UNKNOWN", "<html>": "UNKNOWN", "": "UNKNOWN", "one\ntwo\n": "UNKNOWN", 'x,"a\nb"\n1,2\n': "CSV"}
    for text, want in cases.items():
        assert whole(text.encode()) == want, text
    assert whole(b"\xff\xfe,b\n1,2\n") == "UNKNOWN" and whole(b"PAR1" + bytes(20) + b"PAR1") == "PARQUET" and whole(b"PAR1" + bytes(20)) == "UNKNOWN"
    long = "\n".join(f"é{i},b" for i in range(40_000)).encode()
    assert whole(long) == "CSV" and whole(json.dumps(["é" * 100_000]).encode()) == "JSON"


def test_large_files_are_read_by_ranges(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{root}/huge.parquet", "wb") as f:
        f.write(b"PAR1")
        f.truncate(3 << 30)  # three gigabytes without any disk
        f.seek(0, os.SEEK_END)
        f.write(b"PAR1")
    os.makedirs(f"{root}/below")
    with open(f"{root}/below/wrong.csv", "wb") as f:
        f.write(zipped(["a"]))
    got = {os.path.basename(r.path): (r.format, r.claimed, r.mismatch) for r in sniff_files(spark, root).collect()}
    assert got == {"huge.parquet": ("PARQUET", "PARQUET", False), "wrong.csv": ("ZIP", "CSV", True)}
    assert "content" not in spark.read.format("binaryFile").load(root).select("path", "length").columns

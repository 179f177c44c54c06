import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from creditweave.llm import warc
from tests.llm.corpus import texts


def pages(spark, rows, extra=""):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string" + extra)


def brute(rows, least=0):
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(equal) if equal else None
        revisit = len(data) >= least and first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.add((page, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return out


def read(spark, frame, range_bytes=warc.RANGE_BYTES, **options):
    manifest = warc.write_archive(frame, **options)
    rows = warc.read_archive(spark, manifest, range_bytes).collect()
    assert all(r.intact for r in rows)
    assert sum(m.records for m in manifest.collect()) == len(rows)
    return rows


def key(rows):
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}


def _rows():
    rows = [(i, f"http://a/{i}\r\nWARC-Type: x", t) for i, t in enumerate(texts())]
    rows += [(500 - i, "u", "same page") for i in range(60)] + [(None, None, "same page"), (None, "u", "alone"), (-7, "u", "x")]
    rng = random.Random(2)
    return rows + [(700 + i, "u", "".join(chr(rng.randrange(32, 2000)) for _ in range(3000))) for i in range(40)]


def test_round_trip_by_ranges_of_any_size(spark):
    rows = _rows()
    frame = pages(spark, rows).repartition(3)
    for size in (997, 30_000, warc.RANGE_BYTES):
        got = read(spark, frame, size)
        assert len(got) == len(rows) and key(got) == brute(rows)
    payloads = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert all(bytes(payloads[p]) == (h or "").encode() for p, _, h in rows if p in payloads and p is not None)


def test_least_bytes_repeats_and_empty(spark):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "long enough"), (4, "u", "long enough"), (3, "u", "long enough")]
    got = read(spark, pages(spark, rows), least_bytes=6)
    assert len(got) == 5 and key(got) == brute(rows, 6)
    empty = pages(spark, [(1, "u", "x", 2)], ", bytes int").limit(0)
    assert read(spark, empty) == []


def test_magic_inside_payloads_and_damage(tmp_path):
    """Members stored without compression hold whole inner members; damaged ones are passed over."""
    inner = warc.record(77, "u", b"inner", None, False)
    stored = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Date: x\r\n"
    block = warc.HTTP_HEAD + inner * 3 + b"\x1f\x8b\x08" * 50
    data = stored + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    outer = gzip.compress(data, 0)
    broken = bytearray(warc.record(8, "u", b"broken" * 40, None, False))
    broken[-6] ^= 0xFF
    archive = warc.record(1, "u", b"a" * 5000, None, False) + outer + bytes(broken) + warc.record(2, "u", b"", 1, True)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(archive)
    found = [f["WARC-Record-ID"] for f, _ in warc.read_range(str(path), len(archive), 0, len(archive))]
    # The damaged member is dropped; the record before it is kept, as a member follows.
    assert found == ["<urn:page:1>", "<urn:page:5>", "<urn:page:2>"]
    found = [f["WARC-Record-ID"] for s in range(0, len(archive), 64) for f, _ in warc.read_range(str(path), len(archive), s, min(s + 64, len(archive)))]
    assert {"<urn:page:1>", "<urn:page:5>", "<urn:page:2>"} <= set(found)


def test_headers_of_any_length(spark):
    """Urls that do not compress: longer than a step of the reader, and longer than a range."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/&=") for _ in range(n)), f"page {i}") for i, n in enumerate((10, 70_000, 200_000, 400_000, 10))]
    for size in (5_000, warc.RANGE_BYTES):
        got = read(spark, pages(spark, rows).coalesce(1), size)
        assert key(got) == brute(rows) and sorted(r.url for r in got) == sorted(u for _, u, _ in rows)


def test_lost_and_damaged_records_raise(spark):
    manifest = warc.write_archive(pages(spark, _rows()))
    found = warc.read_archive(spark, manifest)
    assert warc.verified(found, manifest).count() == len(_rows())
    with pytest.raises(warc.ArchiveError, match="records of"):
        warc.verified(found.where("page_id <> 3"), manifest)
    with pytest.raises(warc.ArchiveError, match="1 do not"):
        warc.verified(found.withColumn("intact", F.expr("intact AND NOT page_id <=> 3")), manifest)

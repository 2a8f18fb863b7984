from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisark.llm import warc
from palisark.session import shared_path

PAGE = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages, least=0):
    keep = defaultdict(lambda: -1)
    for i, _, h in pages:
        keep[h or ""] = max(keep[h or ""], i)
    out = []
    for i, _, h in pages:
        size = len((h or "").encode())
        again = size >= least and keep[h or ""] != i
        out.append((i, size, digest(h), "revisit" if again else "response", keep[h or ""] if again else None))
    return sorted(out)


@pytest.fixture
def pages():
    rng = random.Random(2)
    made = [(i, f"https://e.org/{i}?q=a b", f"<p>{rng.random()} é漢 \r\n\r\n WARC/1.1\r\n \x00 \x1f\x8b\x08</p>" * rng.randrange(1, 60)) for i in range(40)]
    made += [(i, None, "same") for i in range(40, 70)]
    return [*made, (70, "", None), (71, "u", ""), (72, "u", "x" * 300_000), (73, "a\r\nb", "y")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, rows, pages, least):
    df = spark.createDataFrame(pages, PAGE).repartition(4)
    assert sorted(rows(warc.round_trip(df, min_revisit_bytes=least)), key=lambda r: r[0]) == expected(pages, least)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], PAGE)
    assert warc.round_trip(df).collect() == []
    df = spark.createDataFrame([(1, "u", "h")], PAGE).withColumns({"sha1": F.lit(1), "keep": F.lit(2), "payload": F.lit(3)})
    assert warc.round_trip(df).collect()[0].payload_digest == digest("h")


def test_repeated_and_null_ids(spark, rows):
    df = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (None, "u", "h"), (None, None, None)], PAGE)
    found = rows(warc.round_trip(df), "page_id", "record_type", "refers_to")
    assert sorted(found, key=repr) == sorted([(1, "response", None)] * 2 + [(None, "revisit", 1), (None, "response", None)], key=repr)


@pytest.mark.parametrize("compressed", [True, False])
def test_payloads_come_back(spark, pages, compressed):
    path = shared_path(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, PAGE).repartition(3), path, compressed=compressed)
    found = warc.read(spark, path)
    assert warc.gaps(found).count() == 0
    got = {r.page_id: bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert all(got[i] == (h or "").encode() for i, _, h in pages if i in got)
    assert len(got) == len({h or "" for *_, h in pages})


def archive(n=8):
    rng = random.Random(6)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(50, 900))) for _ in range(n)]
    records = [warc.record(i, f"u{i}", p, len(p), warc.base32_sha1(p), None) for i, p in enumerate(payloads)]
    return records, [warc._member(r) for r in records]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_after_any_damage(compressed):
    """Whatever one byte is changed to, only its record is lost, and gaps and records cover the file."""
    plain, members = archive()
    parts = members if compressed else plain
    rng = random.Random(9)
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    for _ in range(150):
        at = rng.randrange(len(whole))
        data = bytearray(whole)
        data[at] ^= 1 << rng.randrange(8)
        hit = next(k for k in range(len(parts)) if starts[k] <= at < starts[k + 1])
        found = list(warc.salvage(bytes(data)))
        covered = sorted({(o, n) for o, n, *_ in found})
        assert covered[0][0] == 0 and sum(n for _, n in covered) == len(data)
        assert all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:]))
        ids = {f["warc-record-id"] for _, _, f, _ in found if f}
        assert ids >= {f"<urn:page:{k}>" for k in range(len(parts)) if k != hit}


def test_salvage_truncation_insertions_and_mixed_forms():
    plain, members = archive(4)
    ids = lambda data: [f["warc-record-id"][10:-1] if f else None for _, _, f, _ in warc.salvage(data)]
    assert ids(members[0] + b"junk\x1f\x8b\x08junk" + members[1]) == ["0", None, "1"]
    assert ids(members[0] + members[1][:-5]) == ["0", None]
    assert ids(members[0][20:] + plain[1] + members[2]) == [None, "1", "2"]
    assert ids(b"") == [] and ids(b"nothing") == [None]
    assert ids(gzip.compress(plain[0] + plain[1]) + members[2]) == ["0", "1", "2"]


def test_gap_log_from_files(spark, tmp_path):
    _, members = archive(3)
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"xx" + members[1])
    found = warc.read(spark, f"file://{tmp_path}")
    assert [(r.offset, r.length) for r in warc.gaps(found).collect()] == [(len(members[0]), 2)]
    assert sorted(r.page_id for r in found.where("not gap").collect()) == [0, 1]


def test_long_urls_come_back(spark, rows):
    made = [(1, "data:," + "x" * 100_000, "a"), (2, "\x01" * 30_000, "b"), (3, "u", "c")]
    df = spark.createDataFrame(made, PAGE)
    assert sorted(rows(warc.round_trip(df))) == expected(made)


def test_salvage_inside_a_member_of_several_records():
    plain, members = archive(5)
    ids = lambda data: [f["warc-record-id"][10:-1] if f else None for _, _, f, _ in warc.salvage(data)]
    hurt = bytearray(plain[2])
    hurt[-20] ^= 1
    mixed = plain[0] + plain[1] + bytes(hurt) + plain[3]
    assert ids(members[4] + gzip.compress(mixed) + members[4]) == ["4", "0", "1", "3", None, "4"]
    assert ids(b"junk" + gzip.compress(b"".join(plain[:4]))[:-1200] + members[4])[-2:] == [None, "4"]
    for level in (0, 6):
        whole = gzip.compress(b"".join(plain[:4]), level)
        cut = sum(map(len, plain[:3])) * len(whole) // sum(map(len, plain[:4]))
        got = ids(whole[: cut + 30] + members[4])
        assert set(got) >= {"0", "1", None, "4"} and len(got) == len(set(got))
        crc = bytearray(whole)
        crc[-6] ^= 1
        assert ids(bytes(crc) + members[4]) == ["0", "1", "2", "3", None, "4"]
        assert ids(bytes(crc) + whole + members[0]) == ["0", "1", "2", "3", None, "0", "1", "2", "3", "0"]


def test_files_are_bounded_by_bytes(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "MAX_FILE_BYTES", 600_000)
    path = shared_path(spark, "bounded")
    warc.write(spark.createDataFrame(pages, PAGE).coalesce(1), path)
    assert spark.read.format("binaryFile").load(path).count() >= len(pages) // 2
    assert warc.read(spark, path).where("not gap").count() == len(pages)

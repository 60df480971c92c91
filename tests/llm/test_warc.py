import gzip
import hashlib
import random
import zlib

import pytest

from vecspark.llm import warc

SCHEMA = "page_id long, url string, html string, payload_digest string"
BIG = "é" * 600  # 1,200 bytes


def pages(spark, rows, partitions=3):
    """With an extra column whose name clashes with a result's."""
    return spark.createDataFrame([(*r, "other") for r in rows], SCHEMA).repartition(partitions)


def brute(rows):
    """Expected records: (page_id, bytes, digest, type, refers_to)."""
    largest = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 1000:
            largest[data] = max(i, largest.get(data, i))
    found = []
    for i, _, html in rows:
        data = (html or "").encode()
        target = largest.get(data)
        again = target is not None and target != i
        found.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", target if again else None))
    return sorted(found, key=repr)


def read(spark, folder, **options):
    return warc.page_records(warc.read_archives(spark, folder, **options))


EDGE = [
    (1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "http://c d\r\nX: y", ""), (5, "", None),
    (6, "http://e", "x" * 999), (7, "http://f", "x" * 999), (8, "http://g", "x" * 1000), (-9, "http://h", "x" * 1000),
    (None, "http://i", "x" * 1000), (None, "http://j", "z" * 2000), (None, "http://k", "z" * 2000), (10, "u", BIG), (10, "u", BIG),
    (11, "v", "\r\n\r\nHTTP/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (12, "w", "\x1f\x8b\x08\x00" * 400), (13, "w", "\x00" * 3000),
]


def test_round_trip_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path / "out")
    warc.write_archives(pages(spark, EDGE), folder)
    assert sorted((tuple(r) for r in read(spark, folder).collect()), key=repr) == brute(EDGE)
    records = warc.read_archives(spark, folder, payloads=True)
    assert warc.unresolved(records).isEmpty()
    whole = {(r["record_id"], bytes(r["payload"])) for r in records.where("payload IS NOT NULL").collect()}
    assert whole >= {(warc.page_urn(i), (h or "").encode()) for i, _, h in EDGE if i in (4, 5, 6, 8, 10, 11, 12, 13)}
    uris = {r["record_id"]: r["target_uri"] for r in records.collect()}
    assert uris[warc.page_urn(4)] == "http://c%20d%0D%0AX:%20y" and uris[warc.page_urn(3)] is None


@pytest.mark.parametrize("broadcast", [1, 0])
def test_shared_digests_beyond_a_broadcast(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(warc, "HEAVY", 3)
    rows = EDGE + [(100 + i, "u", f"{i % 7} " * 700) for i in range(40)]
    folder = str(tmp_path / "out")
    warc.write_archives(pages(spark, rows), folder)
    assert sorted((tuple(r) for r in read(spark, folder).collect()), key=repr) == brute(rows)


def test_every_member_is_one_record(spark, tmp_path):
    warc.write_archives(pages(spark, EDGE), str(tmp_path / "out"))
    members = 0
    for path in (tmp_path / "out").glob("part-*"):
        raw = path.read_bytes()
        while raw:
            inflate = zlib.decompressobj(31)
            record = inflate.decompress(raw)
            assert inflate.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            raw, members = inflate.unused_data, members + 1
    assert members == len(EDGE)


def test_long_texts_and_small_splits(spark, tmp_path):
    rng = random.Random(3)
    noisy = "".join(chr(rng.randrange(32, 0x24F)) for _ in range(200_000))
    rows = [(i, "u", noisy[i:]) for i in range(6)] + [(50, "tall", "long " * 4_000_000), (51, "tall", "long " * 4_000_000)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "out"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
    try:
        records = warc.read_archives(spark, str(tmp_path / "out"))
        assert records.rdd.getNumPartitions() > 10
        assert sorted((tuple(r) for r in warc.page_records(records).collect()), key=repr) == brute(rows)
        assert records.where("record_type = 'metadata'").count() == 1  # beside the record above 16 MiB
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table(spark, tmp_path):
    warc.write_archives(pages(spark, [], 1).limit(0), str(tmp_path / "out"))
    assert read(spark, str(tmp_path / "out")).collect() == []


def other_archive(tmp_path, record: bytes):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(warc.member(record) * 2)
    return str(tmp_path / "in")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"plain words"
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <urn:x>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    record %= hashlib.sha1(body).hexdigest().encode(), len(body), body
    raw = b"".join(gzip.compress(record, mtime=0) for _ in range(3))
    (tmp_path / "a.warc").write_bytes(raw)
    found = warc.read_archives(spark, str(tmp_path / "a.warc"), start=raw[:10], payloads=True).collect()
    assert [(r["record_type"], r["payload_bytes"], bytes(r["payload"])) for r in found] == [("resource", len(body), body)] * 3


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda r: r.replace(b"hello", b"hallo"), "does not match its digest"),
        (lambda r: r.replace(b"Content-Length: 64", b"Content-Length: 63"), "does not end where"),
        (lambda r: r.replace(b"Content-Length: 64", b"Content-Length: 640"), "missing"),
        (lambda r: r.replace(b"WARC/1.1", b"WORC/1.1"), "WARC/"),
        (lambda r: r + b"more", "does not end where"),
    ],
)
def test_damage_is_an_error(spark, tmp_path, change, message):
    whole = zlib.decompress(warc.page_record(1, "u", b"hello", None), 31)
    size = len(whole) - whole.index(b"HTTP/1.1") - 4
    whole = whole.replace(b"Content-Length: %d\r\n\r\nHTTP" % size, b"Content-Length: 64\r\n\r\nHTTP") if size == 64 else whole
    fitted = lambda m: m.replace(b"Content-Length: 64", b"Content-Length: %d" % size)
    base = whole.replace(b"Content-Length: %d" % size, b"Content-Length: 64")
    wrong = change(base)
    wrong = wrong.replace(b"Content-Length: 640", b"Content-Length: %d" % (size + 500)).replace(b"Content-Length: 63", b"Content-Length: %d" % (size - 1))
    folder = other_archive(tmp_path, fitted(wrong))
    with pytest.raises(Exception, match=message):
        warc.read_archives(spark, folder).collect()
    assert fitted(base) == whole


def test_a_cut_member_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc.page_record(1, "u", b"hello" * 100, None)[:-20])
    with pytest.raises(Exception, match="missing|inflated|end"):
        warc.read_archives(spark, str(tmp_path / "a.warc")).collect()

"""Archives: round trips with magic inside payloads, splittable files, segments, odd inputs."""

import gzip
import hashlib

import pytest

from minim.llm import warc


def plain(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        if i is not None:
            data = (html or "").encode()
            again = len(data) >= 100 and first[html or ""] != i
            out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\n"
ROWS = [
    (1, "http://a", "<html>" + "x" * 200), (2, None, "<html>" + "x" * 200), (3, "http://b\r\nX: 1", "short"), (4, "http://c", "short"), (5, "http://d", None),
    (6, "http://e", ""), (7, "http://ü", "é中" * 100 + "\r\n\r\n" + "end\r\n\r\n"), (8, "u", "in the middle " + FAKE + " and after " * 30), (9, "u", FAKE * 3), (10, "u", "WARC/1.1\r\n" * 5),
    (11, "u", "WARWARC/1.1\r\nx"), (12, "u", "tail WARC/1.1\r\n"), (None, "u", "no id"), (1, "again", "<html>" + "x" * 200), (13, "u", FAKE.replace(": 5", ": 999999")),
]


@pytest.fixture()
def pages(spark):
    more = [(100 + i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50) + (FAKE if i % 7 == 0 else "")) for i in range(400)]
    return spark.createDataFrame(ROWS + more, "page_id long, url string, html string").repartition(3), ROWS + more


def test_round_trip(spark, pages):
    assert as_rows(warc.archive_round_trip(pages[0])) == plain(pages[1])
    nothing = spark.createDataFrame([], pages[0].schema)
    assert as_rows(warc.archive_round_trip(nothing)) == []


def test_splits_and_segments(spark, pages, tmp_path):
    """Uncompressed archives are cut into many splits, and chains cross many segments."""
    warc.write_archives(pages[0].coalesce(1), str(tmp_path / "gz"))
    flat = str(tmp_path / "flat")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "gz").glob("part-*.gz")))
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.warc").write_bytes(data)
    (tmp_path / "flat" / "b.warc").write_bytes(data[:data.index(b"WARC/1.1", 10)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = as_rows(warc.read_archives(spark, flat, 1500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    head = data[:data.index(b"WARC/1.1", 10)].count(b"WARC-Record-ID")
    assert head == 1 and len(found) == len(plain(pages[1])) + 1
    assert sorted(set(found), key=str) == sorted(set(plain(pages[1])), key=str)


def test_broken_chain_ends_its_file(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(good % 1 + b"damage" + good % 2)
    assert [r["page_id"] for r in warc.read_archives(spark, str(tmp_path)).collect()] == [1]


def read_twice(spark, path, monkeypatch, second):
    """The records of `path`, where the second read of the archives is `second` of a read with files dealt otherwise."""
    first, reads = warc._pieces, []

    def pieces(spark, path):
        reads.append(path)
        if len(reads) == 1:
            return first(spark, path)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return second(first(spark, path))

    monkeypatch.setattr(warc, "_pieces", pieces)
    spark.conf.set("spark.sql.files.minPartitionNum", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return as_rows(warc.read_archives(spark, path))
    finally:
        assert len(reads) == 2
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cut_records_whatever_the_packing(spark, pages, tmp_path, monkeypatch):
    warc.write_archives(pages[0].repartition(6), str(tmp_path / "gz"))
    assert read_twice(spark, str(tmp_path / "gz"), monkeypatch, lambda df: df) == plain(pages[1])


def test_lost_piece_fails(spark, pages, tmp_path, monkeypatch):
    warc.write_archives(pages[0], str(tmp_path / "gz"))
    with pytest.raises(Exception, match="was not found again"):
        read_twice(spark, str(tmp_path / "gz"), monkeypatch, lambda df: df.where(~df["value"].contains("in the middle")))

import hashlib

import duckdb
import pytest
import zstandard as zstd

from crossloom.llm import warc
from crossloom.llm.common import shared_folder

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, rows, **options):
    path = shared_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), path, **options)
    return path, warc.read(spark, path)


def test_same_as_sql(spark, sf):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(map(tuple, warc.query(spark, sf).select(*cols).collect()))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
        assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({warc.SQL})").fetchall())


def test_payloads_come_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = shared_folder(spark, "warc-test")
    warc.write(pages, path, archive_bytes=45_000)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    for r in pages.collect():
        assert got[r.page_id].payload.decode() == r.html and got[r.page_id].url == r.url
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(files) > 1 and any(f.startswith(warc.DICTIONARY_MAGIC) for f in files)


def test_copies_and_odd_rows(spark):
    long, short = "x" * 200, "y" * 99
    rows = [(5, "u", long), (3, "a b\r\n<c>", long), (9, None, long), (None, "u", long), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u", ""), (7, "é", "é" * 60), (7, "é", "é" * 60), (8, "u", "é" * 60)]
    _, table = round_trip(spark, rows)
    got = table.collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        kinds.setdefault(r.page_id, set()).add((r.record_type, r.refers_to, r.payload_bytes))
        raw = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_digest == hashlib.sha256(raw).hexdigest() and (r.payload == raw if r.record_type == "response" else r.payload is None)
    assert kinds == {
        3: {("response", None, 200)}, 5: {("revisit", 3, 200)}, 9: {("revisit", 3, 200)}, None: {("revisit", 3, 200)}, 1: {("response", None, 99)}, 2: {("response", None, 99)},
        4: {("response", None, 0)}, 6: {("response", None, 0)}, 7: {("response", None, 120)}, 8: {("revisit", 7, 120)},
    }
    assert {r.url for r in got if r.page_id == 3} == {"a%20b%0D%0A%3Cc%3E"}


def test_empty_table(spark):
    path = shared_folder(spark, "warc-test")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).collect() == []


def records(n=40):
    out = []
    for i in range(n):
        body = f"<p>{i} {'common words of a page ' * 300}</p>".encode()
        out.append(warc.record(i, "http://x/", body, hashlib.sha256(body).hexdigest()))
    return out


def test_archive_is_a_dictionary_and_a_frame_per_record():
    whole = warc.archive(records())
    assert whole.startswith(warc.DICTIONARY_MAGIC) and len(list(warc.read_archive(whole + warc.EMPTY_FRAME))) == 40
    size = int.from_bytes(whole[4:8], "little")
    packed = zstd.ZstdCompressor().compress(whole[8 : 8 + size])  # a dictionary that is compressed itself
    other = warc.DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed + whole[8 + size :]
    assert list(warc.read_archive(other)) == list(warc.read_archive(whole))


@pytest.mark.parametrize("break_it", [
    lambda a: a[:-3], lambda a: a[:20], lambda a: a[:-3] + b"abc", lambda a: a + b"junk", lambda a: a[:9] + b"\0\0\0\0" + a[13:],
    lambda a: a[8 + int.from_bytes(a[4:8], "little") :],
])
def test_broken_archives_are_refused(break_it):
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(break_it(warc.archive(records()))))


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"HTTP/9"), (b"WARC-Date: ", b"X-Date: "), (b"Content-Length: 9", b"Content-Length: 8"), (b"common", b"uncommon"), (b"WARC-Type: response", b"WARC-Type: other"),
    (b"sha256:", b"sha256:0"), (b"WARC-Type: response", b"WARC-Type response"),
])
def test_broken_records_are_refused(old, new):
    body = b"common" * 150
    plain = warc.record(1, "u", body, hashlib.sha256(body).hexdigest())
    assert warc.entry(*warc.parse(plain))[0] == 1
    assert old in plain
    with pytest.raises(warc.ArchiveError):
        warc.entry(*warc.parse(plain.replace(old, new, 1)))

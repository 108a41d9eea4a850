import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from labelmill.llm import warc_chunks as wc
from labelmill.session import scratch_dir
from tests.conftest import SF_DIR

PAGES = "page_id long, url string, html string, payload string, record_type string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (1, "http://a/1", "<p>one</p>"),
        (2, "http://a/2", "<p>one</p>"),
        (3, None, None),
        (4, "http://a/4 with\r\nbreaks", ""),
        (5, "http://a/é", "é😀\r\n\r\nWARC/1.1\r\n\x00" * 3),
        (6, "http://a/6", "0123456789" * 30_000),
        (None, "http://a/n", "<p>one</p>"),
        (None, "http://a/n", "no id at all"),
        (7, "http://a/7", "seven" * 40),
        (7, "http://a/7", "seven" * 40),
        (7, "http://a/7", "other payload of 7"),
        (8, "http://a/8", "seven" * 40),
    ]
    return spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES)


def expected(rows, least=0):
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first = {}
    for i, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    for i, h in rows:
        original = first.get(h) if len(h) >= least else None
        again = original is not None and original != i
        yield (i, len(h), sha(h), "revisit" if again else "response", original if again else None)


@pytest.mark.parametrize(("chunk", "least"), [(wc.CHUNK, 0), (16, 0), (1000, 11)])
def test_archives_give_back_what_was_written(spark, odd_pages, chunk, least):
    path = scratch_dir(spark, "test-archives")
    table = wc.chunk_table(odd_pages, least, chunk)
    wc.write_archives(table, path)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in odd_pages.collect()]
    found = [tuple(r) for r in wc.read_records(spark, path).collect()]
    assert sorted(found, key=str) == sorted(expected(rows, least), key=str)
    parts = wc.read_chunks(spark, path)
    assert parts.agg(F.max(F.octet_length("data"))).first()[0] <= chunk
    six = parts.filter(F.col("record").startswith("<urn:page:6:")).orderBy("chunk_no").collect()
    assert b"".join(bytes(r["data"]) for r in six) == b"0123456789" * 30_000


def test_chunks_carry_the_digest_so_far(spark, odd_pages):
    for row in wc.chunk_table(odd_pages.filter("page_id in (1, 2, 6)"), 0, 1000).collect():
        payload = b"0123456789" * 30_000 if row["page_id"] == 6 else b"<p>one</p>"
        begun = payload[: row["chunk_no"] * 1000]
        assert row["so_far"] == base64.b32encode(hashlib.sha1(begun).digest()).decode()
        assert row["chunk_no"] < row["chunks"] or row["so_far"] == row["payload_digest"]
        assert len(row["member"]) < 2000 and (row["record_type"] == "revisit") == (row["page_id"] == 2)


def test_files_are_plain_gzip_members(spark, odd_pages):
    path = scratch_dir(spark, "test-archives")
    wc.write_archives(wc.chunk_table(odd_pages.filter("page_id < 3")), path)
    content = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{path.removeprefix('file://')}/part-*")))
    assert content.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:page:1:" in content
    assert content.endswith(b"\r\n\r\n") and content.count(b"<p>one</p>") == 1


def test_a_changed_payload_is_an_error(spark, odd_pages):
    path = scratch_dir(spark, "test-archives")
    table = wc.chunk_table(odd_pages.filter("page_id = 7 and html like 'seven%'"), 0, 50)
    wc.write_archives(table.filter("chunk_no <> 2"), path)
    with pytest.raises(Exception, match="does not have the payload"):
        wc.read_records(spark, path).collect()


def test_no_pages(spark, odd_pages):
    path = scratch_dir(spark, "test-archives")
    wc.write_archives(wc.chunk_table(odd_pages.limit(0)), path)
    assert wc.read_records(spark, path).count() == 0


def test_query_equals_its_sql(spark):
    ok, note = compare(spark, connect(SF_DIR), "op7_warc_chunks", SF_DIR)
    assert ok, note

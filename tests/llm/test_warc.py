import hashlib

import pytest

from postings_engine.llm import warc
from postings_engine.llm.common import Scratch
from postings_engine.llm.queries import QUERIES


def expected(rows, least=1000):
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(largest.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        holder = largest.get(html or "") if len(data) >= least else None
        revisit = holder is not None and holder != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=str)


ODD = [(1, "http://a/", "x" * 1000), (5, "http://b/\r\nX: y", "x" * 1000), (3, None, "x" * 1000), (7, "http://c/", "x" * 999), (8, "http://d/", "x" * 999), (9, "é %41", None), (10, "", ""), (11, "http://e/", "é" * 500),
       (12, "u", "WARC/1.1\r\n\r\nfake\r\n\r\n" * 3), (13, "u", "long " * 400_000), (1, "http://a/", "x" * 1000), (None, "u", "x" * 1000), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture
def odd_pages(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ODD], "page_id long, url string, html string, digest string, holder string")


def test_query_round_trip(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op7_warc"](spark, sf).collect()), key=str) == expected(pages)


def test_odd_pages(spark, odd_pages):
    got = warc.archive(spark, odd_pages).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == expected(ODD)
    held = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert held[13] == b"long " * 400_000 and held[9] == b"" and held[12].startswith(b"WARC/1.1\r\n\r\nfake")
    urls = {r.page_id: r.url for r in got}
    assert urls[3] is None and urls[5] == "http://b/%0D%0AX: y" and urls[9] == "é %41" and urls[10] == ""
    assert warc.archive(spark, odd_pages.limit(0)).count() == 0


def test_records_are_fetched_by_frame(spark, odd_pages):
    scratch = Scratch(spark, "test")
    folder = scratch.new_path("bundles")
    index = warc.write_warc(odd_pages.coalesce(2), folder, scratch, frame_bytes=1500)
    assert index.select("bundle", "frame").distinct().count() > 3
    got = warc.fetch(index, folder, spark.createDataFrame([(13,), (12,), (5,), (99,)], "page_id long")).collect()
    assert {(r.page_id, r.payload_bytes) for r in got} == {(13, 2_000_000), (12, len(ODD[8][2])), (5, 1000)}


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, odd_pages):
    import glob

    import zstandard
    scratch = Scratch(spark, "test")
    folder = scratch.new_path("bundles")
    warc.write_warc(odd_pages.coalesce(1), folder, scratch, frame_bytes=3000)
    path = glob.glob(folder.removeprefix("file:") + "/*.zst")[0]
    raw = open(path, "rb").read()
    assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little")
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole.count(b"WARC-Record-ID: ") == len(ODD)


def test_unindexed_bundles_are_not_read(spark, odd_pages):
    scratch = Scratch(spark, "test")
    folder = scratch.new_path("bundles")
    index = warc.write_warc(odd_pages, folder, scratch)
    warc.write_warc(odd_pages.limit(3), folder, scratch)  # as a lost attempt may leave behind
    assert warc.read_warc(index, folder).count() == len(ODD)

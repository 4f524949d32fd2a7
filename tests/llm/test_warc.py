import gzip
import hashlib
from collections import defaultdict

import pytest

from loomgraph.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é" + "x" * 1200
    rows = [(k, f"http://Host{k % 3}.example.com:80{k % 2}/a b?q={k}#f", big if k % 4 == 0 else f"<p>{k}" + "y" * (k * 90)) for k in range(1, 60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x.org", "s" * 999), (103, "http://x.org", "s" * 999), (104, "http://x.org", "s" * 1000), (105, "http://x.org", "s" * 1000), (106, "junk\r\nX: y", "z\r\n\r\nz")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages):
    rows, df = pages
    last = defaultdict(int)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last[h], i)
    found = {r.page_id: r for r in warc.warc_round_trip(df).collect()}
    assert len(found) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        kind = "revisit" if h in last and last[h] != i else "response"
        assert tuple(found[i]) == (i, len(raw), hashlib.sha1(raw).hexdigest(), kind, last[h] if kind == "revisit" else None)
    assert warc.warc_round_trip(df.where("page_id < 0")).count() == 0


def test_archives_are_gzip_files(pages, tmp_path):
    rows, df = pages
    archives = warc.write_archives(warc.plan_records(df), f"file://{tmp_path}/warc").collect()
    files = defaultdict(int)
    for r in sorted(archives, key=lambda r: (r.archive, r.offset)):
        assert r.offset == files[r.archive]
        files[r.archive] += r.length
    data = {f: open(f.removeprefix("file://"), "rb").read() for f in files}
    assert {f: len(x) for f, x in data.items()} == files and len(list((tmp_path / "warc").iterdir())) == len(files)
    text = b"".join(map(gzip.decompress, data.values()))
    assert text.count(b"WARC/1.1\r\n") == len(rows)


def test_index_finds_each_capture_and_no_other(spark, pages):
    rows, df = pages
    archives = warc.write_archives(warc.plan_records(df))
    index = warc.write_index(archives, block_lines=3, range_lines=7)
    assert index.count() >= len(rows) // 3 and index.select("key_range").distinct().count() > len(rows) // 14
    wanted = spark.createDataFrame([(rows[0][1], rows[0][0]), (rows[0][1], 999), ("http://nowhere", 1), (None, 100)], "url string, page_id long")
    assert {r.page_id for r in warc.lookup(index, wanted).collect()} == {rows[0][0], 100}


def test_keys():
    assert warc.url_key("https://www.Example.com/A?b=1#c") == "com,example)/A?b=1"
    assert warc.url_key("http://u@a.b:81") == "b,a:81)/"
    assert warc.url_key(None) == ")/"


def test_repeated_page_ids(spark):
    big, other = "h" * 1500, "i" * 1500
    rows = [(1, "http://a", big), *[(2, "http://a", big)] * 300, (2, "http://b", big), (2, "http://a", other), (3, "http://a", "small"), (3, "http://a", "small"), (1, "http://a", big), (0, "http://a", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = warc.warc_round_trip(df).collect()
    of = lambda h: hashlib.sha1(h.encode()).hexdigest()
    want = [(1, 1500, of(big), "revisit", 2)] * 2 + [(2, 1500, of(big), "response", None)] * 301 + [(2, 1500, of(other), "response", None), (0, 1500, of(other), "revisit", 2)] + [(3, 5, of("small"), "response", None)] * 2
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_a_capture_of_many_lines_spans_blocks_and_ranges(spark):
    df = spark.createDataFrame([(7, "http://a", str(k)) for k in range(60)] + [(8, "http://a", "x"), (6, "http://a", "y")], "page_id long, url string, html string")
    index = warc.write_index(warc.write_archives(warc.plan_records(df)), block_lines=4, range_lines=5)
    wanted = spark.createDataFrame([("http://a", 7), ("http://a", 8), ("http://a", 7), ("http://a", 5)], "url string, page_id long")
    found = [(r.archive, r.offset) for r in warc.lookup(index, wanted).collect()]
    assert len(found) == len(set(found)) == 61

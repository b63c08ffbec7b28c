import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import warc


def brute(pages):
    known = [(i, (h or "").encode(), hashlib.sha1((h or "").encode()).hexdigest()) for i, h in pages]
    out = []
    for i, p, d in known:
        same = [j for j, q, _ in known if q == p and j is not None]
        top = max(same, default=None) if len(p) >= 1000 else None
        again = top is not None and i != top
        out.append((i, len(p), d, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def test_query_matches_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    got = rows(warc.op10_arc_to_warc(spark, sf_dir))
    want = sorted(con.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.OP10_SQL})").fetchall(), key=str)
    assert got == want
    assert got == brute([(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()])


@pytest.mark.parametrize("version", ["1", "2"])
def test_odd_rows(spark, tmp_path, version):
    long, other = "é" * 500, "y" * 999
    pages = [(1, "http://a/ b\n", long), (2, None, long), (3, "http://c/é", other), (4, "u", other), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nHTTP/1.1 x\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\n" + "z" * 100000), (None, "u", long), (2, "u", long), (9, "u", "q" * 5_000_000)]
    frame = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    warc.write_pages(frame, path, version)
    back = warc.read_pages(spark, path)
    assert rows(back) == brute([(i, h) for i, _, h in pages])
    payload = {r.page_id: r.payload.decode() for r in back.filter("record_type = 'response' and page_id > 2").collect()}
    assert payload == {i: h or "" for i, _, h in pages if i and i > 2}
    warc.write_pages(frame.limit(0), path + "0")
    assert warc.read_pages(spark, path + "0").count() == 0




def arc(version, contents, date="20010203040506"):
    data = warc.arc_header(version, "x.arc", date)
    for url, c in contents:
        data += warc.arc_record(version, url, date, c)
    return data


@pytest.mark.parametrize("version", ["1", "2"])
def test_converter(spark, version):
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>\n\n"
    files = [arc(version, [("http://a/", page), ("dns:a", b"20010203 a 1.2.3.4\n")]), arc(version, [("http://b/", b"")]), None]
    found = warc.convert_archives(spark.createDataFrame([(f,) for f in files], "data binary")).collect()
    records = [r for row in found for r in warc.read_warc(row.data)]
    assert [h["WARC-Type"] for h, _ in records].count("warcinfo") == 2 and [r.skipped for r in found] == [0] * len(found)
    records = [(h, b) for h, b in records if h["WARC-Type"] != "warcinfo"]
    by = {h["WARC-Target-URI"]: (h, b) for h, b in records}
    head, block = by["http://a/"]
    assert head["WARC-Type"] == "response" and block == page and head["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert head["WARC-Payload-Digest"] == warc.sha1_32(b"<p>hi</p>\n\n")
    assert by["dns:a"][0]["WARC-Type"] == "resource" and by["http://b/"][0]["Content-Length"] == "0"
    assert len({h["WARC-Record-ID"] for h, _ in records}) == 3


LINES = [
    ("1", "http://a.b/c d 1.2.3.4 20080430204825 text/html 5", "http://a.b/c d", "text/html"),
    ("1", "http://a/ 1.2.3.4 20080430204825 text/html; charset=utf-8 5", "http://a/", "text/html; charset=utf-8"),
    ("1", "http://a/?q=x y 5 2001:db8::1 200804302048 5", "http://a/?q=x y 5", "-"),
    ("1", "http://a/ 9.9.9.9 20010101 b 1.2.3.4 20080430 no-type 5", "http://a/ 9.9.9.9 20010101 b", "no-type"),
    ("1", "dns:a - 20080430204825 text/dns 5", "dns:a", "text/dns"),
    ("2", "http://a.b/c d 1.2.3.4 20080430204825 text/html; charset=utf-8 200 ABC - 77 x.arc 5", "http://a.b/c d", "text/html; charset=utf-8"),
    ("2", "http://a/ 1.2.3.4 20080430204825 text/html 302 - http://b/e f 0 x.arc.gz 5", "http://a/", "text/html"),
    ("2", "http://a/ 1.2.3.4 20080430204825 - 404 - - - x.arc 5", "http://a/", "-"),
]


@pytest.mark.parametrize("version, line, url, kind", LINES)
def test_header_lines_as_archives_have_them(version, line, url, kind):
    head = warc.arc_header(version, "x.arc", "20080430204825")
    data = head + line.encode() + b"\nhello\n" + line.encode() + b"\r\nworld\n\n"
    skipped = []
    (_, block), (one, a), (two, b) = warc.read_arc(data, skipped)
    assert block.startswith(version.encode()) and (a, b) == (b"hello", b"world") and not skipped
    for record in (one, two):
        assert (record["URL"], record["Content-type"], record["Archive-length"]) == (url, kind, "5")
    # without the version block the line is taken for what it looks like
    assert [r["URL"] for r, _ in warc.read_arc(data[len(head) :])] == [url] * 2


def test_bad_records_are_skipped_and_counted(spark):
    body = b"HTTP/1.0 200 OK\r\n\r\nabc\n"
    good = [warc.arc_record("1", f"http://{x}/", "20010203040506", body) for x in "abc"]
    head = warc.arc_header("1", "x.arc", "20010203040506")

    def urls(*parts):
        skipped = []
        found = [r["URL"] for r, _ in warc.read_arc(head + b"".join(parts), skipped)]
        return found[1:], len(skipped)

    a, b, c = good
    assert urls(a, b, c) == (["http://a/", "http://b/", "http://c/"], 0)
    assert urls(a, b.replace(b"20010203040506", b"yesterday"), c) == (["http://a/", "http://c/"], 1)  # by its length
    assert urls(a, b.replace(b" 23\n", b" 2x\n"), c) == (["http://a/", "http://c/"], 1)  # by the next header line
    assert urls(a, b.replace(b" 23\n", b" 999999\n"), c) == (["http://a/", "http://c/"], 1)
    assert urls(a, b.replace(b" 23\n", b" 9\n"), c) == (["http://a/", "http://b/", "http://c/"], 1)
    assert urls(a, b[:-9]) == (["http://a/"], 1)
    assert urls(b"junk", b"\n" * 3, a) == (["http://a/"], 1)
    assert list(warc.read_arc(b"")) == [] and list(warc.read_arc(b"\n\n")) == []
    for junk in (b"junk", b"x" * 300_000, b"\n".join([b"y z 5"] * 1000), bytes(range(256)) * 50):
        skipped = []
        assert list(warc.read_arc(junk, skipped)) == [] and skipped
    files = [head + a + b.replace(b" 23\n", b" 2x\n") + c, b"junk", None, b"", head]
    found = warc.convert_archives(spark.createDataFrame([(f, 1) for f in files], "data binary, skipped int").repartition(1)).collect()
    assert sum(r.skipped for r in found) == 2
    assert [h["WARC-Type"] for r in found for h, _ in warc.read_warc(r.data)].count("response") == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"http://a/", b" ", b"\n", b"1.2.3.4", b"20080430204825", b"text/html", b"5", b"0", b"99", b"\r", b"200", b"-", b"hello", b"\xff", b"1 0 x\n"]), max_size=40))
def test_any_bytes(parts):
    for record, content in warc.read_arc(b"".join(parts)):
        assert len(content) == int(record["Archive-length"])


def test_version_block_becomes_warcinfo(spark):
    page = b"HTTP/1.0 200 OK\r\n\r\nhi"
    files = [arc("2", [("http://a/", page), ("http://b/", page)]), arc("1", [("http://c/", page)])]
    found = warc.convert_archives(spark.createDataFrame([(f,) for f in files], "data binary").repartition(1)).collect()
    records = [r for row in found for r in warc.read_warc(row.data)]
    infos = {h["WARC-Record-ID"]: b for h, b in records if h["WARC-Type"] == "warcinfo"}
    assert len(infos) == 2 and all(b"WARC File Format" in b and b"\r\narc-version: " in b for b in infos.values())
    of = {h["WARC-Target-URI"]: h["WARC-Warcinfo-ID"] for h, _ in records if h["WARC-Type"] == "response"}
    assert set(of.values()) == set(infos) and of["http://a/"] == of["http://b/"] != of["http://c/"]
    with pytest.raises(warc.BadArchive):
        list(warc.read_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_revisits_name_url_and_date_of_their_original(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://one/", "w" * 1000), (2, "http://two/ x", "w" * 1000), (None, "http://none/", "w" * 1000)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_pages(frame, path)
    heads = [h for r in spark.read.parquet(path).collect() for h, _ in warc.read_warc(r.data) if h["WARC-Type"] == "revisit"]
    assert [(h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]) for h in heads] == [("http://two/%20x", "2008-04-30T20:48:25Z")] * 2


def test_revisits_name_their_record(spark, tmp_path):
    text = "w" * 2000
    frame = spark.createDataFrame([(i, "u", text) for i in range(40)] + [(99, None, None)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_pages(frame, path)
    records = {r.page_id: r for r in warc.read_records(spark, path).collect()}
    assert all(records[i].refers_to_id == records[39].record_id for i in range(39)) and records[39].refers_to_id is None
    back = {r.page_id: r for r in warc.read_pages(spark, path, with_payload=False).collect()}
    assert all(back[i].refers_to == 39 for i in range(39)) and back[39].refers_to is None and len(back) == 41
    lost = warc.resolved(warc.read_records(spark, path), warc.read_records(spark, path).filter("page_id <> 39"))
    assert all(r.refers_to is None for r in lost.collect())

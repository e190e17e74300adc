import gzip
import hashlib

import pytest

from lectern.llm import warc


def test_arc_versions():
    body = b"HTTP/1.1 200 OK\r\nX-Row-Id: 7\r\n\r\nfirst\n\nhttp://x 0 0 text/html 5\nlines"
    for v in "12":
        data = b"\n".join((warc.arc_version_block(v, "a.arc"), warc.arc_record(v, "a.arc", "7", "http://e.org/a b?ü", "pa\nyload é".encode()), warc.arc_record(v, "a.arc", "8", None, None)))
        got = list(warc.read_arc(data))
        assert [r["url"] for r in got] == ["http://e.org/a%20b?%C3%BC", "about:blank"] and not any(r["cut"] for r in got)
        head, fields, payload = warc.http_parts(got[0]["body"])
        assert payload.decode() == "pa\nyload é" and fields["x-row-id"] == "7" and head + payload == got[0]["body"]
    line = f"http://e.org/ 1.2.3.4 19960102 text/html {len(body)}\n".encode()
    (r,) = warc.read_arc(warc.arc_version_block("1", "old") + b"\n" + line + body + b"\n")
    assert r["body"] == body and warc.iso_time(r["archive-date"]) == "1996-01-02T00:00:00Z"
    for bad in (b"http://x 1 2 3 4\n", b"filedesc://x 0 0 text/plain 4\n9 0\n", b"filedesc://x"):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_damaged_archives():
    begin = warc.arc_version_block("1", "old") + b"\n"
    one = b"http://e.org/1 1.2.3.4 19960102 text/html 4\nabcd\n"
    spaced = b"http://e.org/a b 1.2.3.4 19960102 text/html 2\nxy\n"
    got = list(warc.read_arc(begin + one + b"a stray line\n\n\x00\xff\n" + spaced + b"http://e.org/2 1.2.3.4 19960102 text/html 99\ncut off"))
    assert [(r["url"], r["body"], r["cut"]) for r in got] == [("http://e.org/1", b"abcd", False), ("http://e.org/a b", b"xy", False), ("http://e.org/2", b"cut off", True)]
    assert list(warc.read_arc(begin)) == list(warc.read_arc(b"")) == []


def test_bytes_status_and_headers_are_kept(spark, tmp_path):
    latin = b"HTTP/1.1 404 Not Found\r\nServer: old\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + "caf\u00e9 \u00df".encode("latin-1") * 300
    binary = b"HTTP/1.0 200 OK\nContent-Type: image/gif\n\n" + bytes(range(256)) * 8
    bodies = [latin, binary, b"HTTP/1.0 204 No Content\r\n\r\n", b"plain text without a head", b"HTTP/1.0 302 Found\r\nLocation: /x"]
    bodies += [b"HTTP/1.1 200 OK\r\nX-Row-Id: %d\r\nX-Own: %d\r\n\r\n" % (i, i) + b"\xff\xfe" * 700 for i in (5, 9)]
    data = warc.arc_version_block("1", "old") + b"\n" + b"".join(b"http://e.org/%d 10.0.0.%d 19990102030405 text/html %d\n%s\n" % (i, i, len(x), x) for i, x in enumerate(bodies))
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(data) + gzip.compress(b""))
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {r.url: r for r in warc.read_warc_files(spark, str(tmp_path / "warc")).collect()}
    assert len(got) == len(bodies)
    for i, x in enumerate(bodies):
        r = got[f"http://e.org/{i}"]
        assert bytes(r.head) + bytes(r.payload if r.payload is not None else b"\xff\xfe" * 700) == x
        assert r.payload_digest == hashlib.sha1(warc.http_parts(x)[2] if x[:5] == b"HTTP/" else x).hexdigest()
    again, whole = got["http://e.org/5"], got["http://e.org/6"]
    assert (again.type, again.refers_to, again.refers_to_id) == ("revisit", 9, whole.record_id) and whole.type == "response"
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo") and b"WARC-IP-Address: 10.0.0.1" in raw and b"WARC-Refers-To-Date: 1999-01-02T03:04:05Z" in raw


def test_other_protocols_become_resources(spark, tmp_path):
    text = warc.arc_version_block("1", "old") + b"\ndns:e.org 1.2.3.4 19960102030405 text/dns 9\n1.2.3.4\n\n\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(text))
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    (r,) = warc.read_warc_files(spark, str(tmp_path / "warc")).collect()
    assert (r.type, r.url, r.time, bytes(r.payload), r.row_id) == ("resource", "dns:e.org", "1996-01-02T03:04:05Z", b"1.2.3.4\n\n", None)


def test_archive(spark):
    big = "é" * 600
    rows = [(i, f"http://h/{i}", big + str(i % 3), 1, "x") for i in range(30)]
    rows += [(100 + i, None, "small", 1, "x") for i in range(4)]
    rows += [(200, "http://h/ \n2", None, 1, None), (201, "u", "", 1, None), (300, "u", "WARC/1.0\r\n\r\n\r\n" * 200, 2, ""), (301, "u", "x" * 1000, 2, ""), (302, "u", "x" * 1000, 2, ""), (303, "u", "y" * 999, 2, ""), (304, "u", "y" * 999, 2, ""), (None, "u", "null id", 2, "")]
    rows += [(400, "u", "z" * 2_000_000, 1, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row_id int, digest string")
    got = {r.row_id: r for r in warc.archive(df).collect()}
    assert len(got) == len(rows)
    firsts = {}
    for i, _, html, _, _ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            firsts[html] = max(firsts.get(html, i), i)
    for i, _, html, _, _ in rows:
        data, to = (html or "").encode(), firsts.get(html, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.type, r.refers_to) == (("revisit", to) if to != i else ("response", None))
        assert (r.payload and bytes(r.payload)) == (None if r.type == "revisit" else data)
    assert len({r.record_id for r in got.values()}) == len(rows)
    assert warc.archive(df.limit(0)).count() == 0

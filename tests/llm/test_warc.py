import hashlib
import io

import pytest

from ferrule.llm import warc


def fields(url="http://a.example/x y", date="20100203040506"):
    return {"URL": url, "IP-address": "10.0.0.1", "Archive-date": date, "Content-type": "text/html", "Result-code": "200"}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_and_conversion(version):
    contents = [b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>a\n\nb</p>", b"", b"plain\nhttp://not.a/header 1 2 3 4\n", b"\x00\xff" * 5000]
    arc = warc.write_arc([(fields(), c) for c in contents], "t.arc", version)
    got = list(warc.read_arc(arc))
    assert [r.content for r in got] == contents and {r.version for r in got} == {version}
    assert got[0].fields["URL"] == "http://a.example/x%20y" and set(got[0].fields) == set(warc.ARC_FIELDS[version])
    h, block = warc.to_warc(got[0])
    assert h["WARC-Type"] == "response" and h["WARC-Date"] == "2010-02-03T04:05:06Z" and h["Content-Type"] == "application/http; msgtype=response"
    assert h["WARC-Payload-Digest"] == warc.sha1_base32(b"<p>a\n\nb</p>") and h["WARC-Block-Digest"] == warc.sha1_base32(contents[0])
    assert warc.to_warc(got[2])[0]["WARC-Type"] == "resource"
    r, block = warc.to_warc(got[0], refers="k")
    assert r["WARC-Type"] == "revisit" and block.endswith(b"\r\n\r\n") and r["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and r["WARC-Refers-To"] == warc.record_id("k")
    ids = {warc.to_warc(x)[0]["WARC-Record-ID"] for x in got}
    assert len(ids) == len(got)
    back = list(warc.read_warc(io.BytesIO(b"".join(warc.warc_bytes(*warc.to_warc(x)) for x in got))))
    assert [b for _, b in back] == contents


def test_malformed_archives_are_refused():
    arc = warc.write_arc([(fields(), b"abc")], "t.arc", 1)
    for bad in (arc[:-3], arc.replace(b"1 0 ferrule", b"7 0 ferrule"), b"x y z\n", arc + b"no header\n", arc.replace(b" 3\n", b" three\n")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    with pytest.raises(ValueError):
        list(warc.read_warc(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    assert warc.iso_date("2010") == "1970-01-01T00:00:00Z" and warc.iso_date("20100101") == "2010-01-01T00:00:00Z"


def test_headers_with_bare_line_feeds():
    for end in (b"\n\n", b"\r\n\r\n", b"\n\r\n"):
        content = b"HTTP/1.0 200 OK\nServer: old" + end + b"<p>a</p>\r\n\r\n\n\nb"
        rec = next(warc.read_arc(warc.write_arc([(fields(), content)], "t.arc", 1)))
        h, block = warc.to_warc(rec)
        assert h["WARC-Payload-Digest"] == warc.sha1_base32(b"<p>a</p>\r\n\r\n\n\nb") and block == content
        assert warc.to_warc(rec, refers="x")[1] == b"HTTP/1.0 200 OK\nServer: old" + end
    alone = next(warc.read_arc(warc.write_arc([(fields(), b"HTTP/1.0 204 None\nServer: old")], "t.arc", 1)))
    assert warc.to_warc(alone)[0]["WARC-Payload-Digest"] == warc.sha1_base32(b"")


def test_dates_and_blanks():
    assert warc.iso_date("20240229235959") == "2024-02-29T23:59:59Z" and warc.iso_date("09991231") == "0999-12-31T00:00:00Z"
    for bad in ("20240231996199", "20230229", "20240101240000", "2024010112", "x", "", "２０２４０１０１000000"):
        assert warc.iso_date(bad) == ("2024-01-01T12:00:00Z" if bad == "2024010112" else "1970-01-01T00:00:00Z"), bad
    got = next(warc.read_arc(warc.write_arc([(fields("http://a/\u2028b\u00a0c d"), b"")], "t.arc", 2)))
    assert got.fields["URL"] == "http://a/%E2%80%A8b%C2%A0c%20d"


def test_archives_in_a_folder(spark, tmp_path):
    import gzip

    contents = [b"HTTP/1.1 200 OK\r\n\r\n<p>a</p>", b"plain", b"z" * 100_000]
    one, two = (warc.write_arc([(fields(), c) for c in contents], "t", v) for v in (1, 2))
    (tmp_path / "a.arc").write_bytes(one)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(two[:60]) + gzip.compress(two[60:]))
    (tmp_path / "cut.arc").write_bytes(one[:-50_000])
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.arc", "b.arc.gz", "cut.arc")], "path string")
    done = {x.source.rsplit("/", 1)[-1]: x for x in warc.convert_archives(paths, f"file://{tmp_path}/out").collect()}
    assert [done[n].records for n in ("a.arc", "b.arc.gz", "cut.arc")] == [3, 3, 2] and done["a.arc"].problem is None and "cut off" in done["cut.arc"].problem
    with gzip.open(done["b.arc.gz"].path.removeprefix("file://")) as f:
        got = list(warc.read_warc(f))
    assert [b for _, b in got[1:]] == contents and [h["WARC-Type"] for h, _ in got] == ["warcinfo", "response", "resource", "resource"]
    assert len({h["WARC-Record-ID"] for h, _ in got}) == 4 and {h["WARC-Warcinfo-ID"] for h, _ in got[1:]} == {got[0][0]["WARC-Record-ID"]}
    assert got[0][0]["WARC-Filename"] == done["b.arc.gz"].path.rsplit("/", 1)[-1] and b"filedesc://t" in got[0][1] and got[0][0]["WARC-Date"] == "2024-01-01T00:00:00Z"


def test_pages_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "u", big), (5, None, big), (3, "u v", big), (7, "u", other), (8, "", "x" * 999), (9, "", "x" * 999), (10, "", None), (11, "", ""), (12, "q", "long " * 100_000), (None, "n", other), (5, "again", big)]
    pages = spark.createDataFrame([(*r, "?") for r in rows], "page_id long, url string, html string, digest string")
    for version in (1, 2):
        root = f"file://{tmp_path}/{version}"
        manifest, got = warc.archive_pages(pages, version=version, root=root)
        got = got.collect()
        assert sum(x.records for x in manifest.collect()) == len(rows) == len(got)
        want = []
        for p, _, t in rows:
            b = (t or "").encode()
            top = max(q for q, _, s in rows if q is not None and (s or "") == (t or ""))
            again = len(b) >= 1000 and (p is None or p < top)
            want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
        assert sorted(map(repr, ((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got))) == sorted(map(repr, want))
    assert warc.archive_pages(pages.where("false"))[1].count() == 0

import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from polyloci.llm import warc as A

SCHEMA = "page_id long, url string, html string, arc string, `index` string, digest string"


def brute(rows, least=0):
    groups = defaultdict(list)
    for key, _, html in rows:
        groups[(html or "").encode()].append(key)
    out = []
    for payload, keys in groups.items():
        keys.sort(key=lambda k: (k is not None, k or 0))
        own = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        for i, key in enumerate(keys):
            again = i < len(keys) - 1 and len(payload) >= least
            out.append((key, *own, "revisit" if again else "response", keys[-1] if again else None))
    return sorted(out, key=str)


def found(spark, rows, parts=3, **options):
    pages = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(parts)
    out = A.archive_pages(pages, **options)
    return sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ODD = [
    (1, "http://a.example/x y", "<p>é\r\n\r\nWARC/1.1 \x00</p>"), (2, None, None), (3, "", ""), (4, "http://b.example/é", "same"), (9, "u", "same"), (9, "u", "same"),
    (None, "http://c.example/", "same"), (None, None, "only"), (5, "x\r\ny", "HTTP/1.1 200 OK\r\n\r\n"), (6, "http://d.example/", "long " * 100_000), (-7, "http://e.example/", "same"),
]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_odd_pages_equal_brute_force(spark, least):
    assert found(spark, ODD, least_bytes=least) == brute(ODD, least)


def test_many_copies_in_many_archives(spark):
    rows = [(i, f"http://h{i}.example/", "copy" if i % 3 == 0 else f"page {i // 2}") for i in range(200)]
    assert found(spark, rows, parts=5, archive_bytes=60) == brute(rows)


def test_no_pages(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    contents = [b"HTTP/1.1 200 OK\r\n\r\nabc\n\n1 2 3 4 5", b"", b"plain text\n"]
    data = A.arc_version_block(version, "x.arc") + b"".join(A.arc_entry(version, "x.arc", b"http://e.example/a b", "20010203040506", "text/html", c) for c in contents)
    records = list(A.arc_records(io.BytesIO(data), "x.arc"))
    assert [r.content for r in records] == contents
    assert {(r.version, r.url, r.date, r.mime) for r in records} == {(version, "http://e.example/a%20b", "20010203040506", "text/html")}


def test_header_lines_of_each_version():
    v1 = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    v1 = v1.replace(b" 76\n", b" %d\n" % (len(v1) - v1.index(b"\n") - 1))
    own = b"\nhttp://www.example.com:80/with a space 10.0.0.1 19961104142103 text/html 5\nhello\n"
    (record,) = A.arc_records(io.BytesIO(v1 + own), "old.arc")
    assert record == A.ArcRecord(1, "http://www.example.com:80/with a space", "10.0.0.1", "19961104142103", "text/html", b"hello")
    fields, block = A.from_arc(record, "old.arc", 1, None)
    assert block == b"hello" and fields["WARC-Type"] == "resource" and fields["WARC-Date"] == "1996-11-04T14:21:03Z" and fields["WARC-IP-Address"] == "10.0.0.1"
    block = b"2 0 Alexa Internet\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v2 = b"filedesc://new.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 new.arc %d\n" % len(block) + block
    own = b"\nhttp://www.example.com/ 10.0.0.1 1997 text/html 200 fac069 - 209 new.arc 5\nhello\n"
    (record,) = A.arc_records(io.BytesIO(v2 + own), "new.arc")
    assert record == A.ArcRecord(2, "http://www.example.com/", "10.0.0.1", "1997", "text/html", b"hello")
    assert A.warc_date("1997") == "1997-01-01T00:00:00Z" and A.warc_date("x") == "1970-01-01T00:00:00Z"


@pytest.mark.parametrize("broken", [b"no block\n", b"filedesc://x 0.0.0.0 19960923142103 text/plain 9\n7 0 what\n\n"])
def test_bad_archives_are_named(broken):
    with pytest.raises(ValueError, match="x.arc"):
        list(A.arc_records(io.BytesIO(broken), "x.arc"))
    whole = A.arc_version_block(1, "x.arc") + A.arc_entry(1, "x.arc", b"u", "20010203040506", "t", b"12345")
    with pytest.raises(ValueError, match="record 1"):
        list(A.arc_records(io.BytesIO(whole[:-3]), "x.arc"))


def test_files_on_disk_are_whole_warcs(spark, tmp_path):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string").coalesce(2)
    arcs = A.write_arcs(pages, str(tmp_path / "arc"))
    warcs = A.convert_arcs(arcs, str(tmp_path / "warc"))
    assert warcs.agg(F.sum("records")).first()[0] == len(ODD)
    ids = set()
    for row in warcs.collect():
        with gzip.open(row["warc"].removeprefix("file://")) as f:
            records = list(A.warc_records(f, row["warc"]))
        assert records[0].fields["warc-type"] == "warcinfo" and len(records) == row["records"] + 1
        ids |= {r.fields["warc-record-id"] for r in records}
        for r in records[1:]:
            assert r.fields["warc-block-digest"] == f"sha1:{A.base32_sha1(r.block)}" and r.fields["warc-warcinfo-id"] in ids
            assert r.fields["warc-type"] == "response" or (r.fields["warc-profile"] == A.REVISIT_PROFILE and r.block.endswith(b"\r\n\r\n"))
    assert len(ids) == len(ODD) + warcs.count()

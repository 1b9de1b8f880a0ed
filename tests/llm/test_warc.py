import hashlib
import io

import pytest
import zstandard

from boundgraph.llm import warc

BIG = "x" * 1500


def rows():
    return [(1, "http://a/1", BIG, "n"), (5, "http://a/5", BIG, "n"), (3, None, BIG, "n"), (7, "u\r\nv", "short", "n"), (8, "u", "short", "n"), (9, "u", None, "n"), (10, "u", "é\r\n\r\nWARC/1.1\r\n" * 200, "n"), (None, "u", BIG, "n"), (11, "u", "y" * 600000, "n"), (7, "again", "short", "n")]


def archived(spark, data, tmp_path):
    pages = spark.createDataFrame(data, "page_id long, url string, html string, digest string")
    return warc.archive_pages(pages, folder=f"file://{tmp_path}/bundles")


def test_round_trip(spark, tmp_path):
    index, _ = archived(spark, rows(), tmp_path)
    got = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"]) for r in warc.read(index, payloads=True).collect())
    want = []
    for i, _, html, _ in rows():
        payload = (html or "").encode()
        revisit = html == BIG and i != 5
        want.append((f"urn:page:{'none' if i is None else i}", "revisit" if revisit else "response", "urn:page:5" if revisit else None, len(payload), hashlib.sha1(payload).hexdigest(), b"" if revisit else payload))
    assert [tuple(x[:5]) + (bytes(x[5]),) for x in got] == sorted(want)
    by_index = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in warc.fetch(index).collect())
    assert by_index == sorted(want)
    one = warc.fetch(index.where("record_id = 'urn:page:10'")).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == rows()[6][2] and one[0]["target_uri"] == "u"
    assert {r["target_uri"] for r in warc.read(index).collect()} == {"http://a/1", "http://a/5", None, "u%0D%0Av", "u", "again"}


def test_any_zstandard_reader_can_read_a_bundle(spark, tmp_path):
    archived(spark, rows(), tmp_path)
    text = b""
    for path in sorted((tmp_path / "bundles").iterdir()):
        assert not path.name.endswith(".part")
        text += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
    assert text.count(b"WARC-Record-ID: ") == len(rows())


def test_an_index_that_names_another_record_is_refused(spark, tmp_path):
    index, _ = archived(spark, rows(), tmp_path)
    wrong = index.where("record_id = 'urn:page:10'").selectExpr("'urn:page:9' record_id", "file", "frame", "offset", "length")
    with pytest.raises(Exception, match="another record"):
        warc.fetch(wrong).collect()


def test_no_pages(spark, tmp_path):
    index, _ = archived(spark, rows()[:0], tmp_path)
    assert index.count() == 0 and warc.read(index).count() == 0 and warc.fetch(index).count() == 0

"""WARC archives and transport streams: exact round trips."""

import glob
import gzip
import hashlib
import random
import zlib

import pytest

from tapeline.llm import media, warc
from tapeline.llm.common import shared_dir

from .conftest import EDGE

LONG = "WARC/1.1\r\n\r\n" * 30 + "é" * 9000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 40_000 + "\r\n" * 500
SCHEMA = "page_id bigint, url string, html string, digest string, origin string, value string"


def pages(spark, rows):
    return spark.createDataFrame([(i, "u", h, "d", "o", "v") for i, h in rows], SCHEMA)


def test_archives_come_back(spark):
    rows = [(1, None), (2, ""), (3, LONG), (5, LONG), (4, LONG), (9, "y" * 99), (8, "y" * 99), (7, "z" * 100), (6, "z" * 100), (10, LONG + "!"), (10, LONG + "!"), (None, "n" * 200), (None, "n" * 200), (None, LONG), (None, None), (11, "q" * 120), (11, "q" * 120), (12, "q" * 120)]
    warc.write_warc(pages(spark, rows), path := shared_dir(spark, "warc"))
    got = {}
    for r in warc.read_warc(spark, path).collect():
        got.setdefault((r.page, r.digest.removeprefix("sha256:")), []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len({r.id for x in got.values() for r in x}) == len(rows)
    for i, h in rows:
        body = (h or "").encode()
        found = got[None if i is None else str(i), hashlib.sha256(body).hexdigest()]
        assert len(found) == rows.count((i, h))
        origin = min((j for j, g in rows if j is not None and (g or "").encode() == body), default=None)
        for r in found:
            if len(body) >= 100 and origin is not None and origin != i:
                assert r.record_type == "revisit" and r.payload is None and r.refers_to == str(origin)
            else:
                assert r.record_type == "response" and bytes(r.payload) == body
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    assert raw.count(b"WARC-Type: continuation") >= 3 and raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.endswith(b"\r\n\r\n")


def test_pages_with_edges(spark):
    rows = [(1, None), (2, "a" * 150), (2, "a" * 150), (3, "a" * 150), (3, "a" * 150), (None, "a" * 150), (None, "b" * 150), (None, "b" * 150), (4, "short"), (4, "short"), (2**60 + 1, LONG * 3)]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(spark, pages(spark, rows)).collect()), key=repr)
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        origin = min((j for j, g in rows if j is not None and g == h), default=None)
        again = len(raw) >= 100 and origin is not None and origin != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", origin if again else None))
    assert got == sorted(want, key=repr)


def test_lost_segment_is_noticed(spark):
    warc.write_warc(pages(spark, [(1, LONG)]), path := shared_dir(spark, "warc"))
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(path + "/*.gz")))
    records = raw.split(b"WARC/1.1\r\n")
    lost = [r for r in records if b"WARC-Segment-Number: 2" not in r]
    out = shared_dir(spark, "broken")
    spark.createDataFrame([(b"WARC/1.1\r\n".join(lost)[:-1].decode(),)], "value string").coalesce(1).write.text(out)
    with pytest.raises(Exception, match="segments missing"):
        warc.read_warc(spark, out).collect()


def test_empty_pages(spark):
    warc.write_warc(pages(spark, []), path := shared_dir(spark, "warc"))
    assert warc.read_warc(spark, path).count() == 0


def test_chunks():
    rng = random.Random(2)
    for _ in range(200):
        body = "".join(rng.choice(["WARC/1.1", "WARC/", "\r\n", "é", "a" * 50, "0\r\n\r\n"]) for _ in range(rng.randint(0, 400)))
        framed = warc.chunked(body)
        assert warc.dechunked(framed.encode()) == body.encode() and warc.MARK not in framed
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 150, 156, 157, 158, 170, 171, 182, 183, 184, 185, 8191, 8192, 8193, 70_001])
def test_streams_come_back(n):
    data = random.Random(n).randbytes(n)
    raw = media.write_stream(data)
    got = media.read_stream(raw)
    assert got["payload"] == data and got["cc_errors"] == 0 and len(raw) % 188 == 0
    assert len(got["pts"]) == -(-n // media.UNIT) and got["random_access"] == list(range(0, len(got["pts"]), media.RAP_EVERY))
    assert got["pts"] == [k * media.UNIT * 90_000 // media.RATE for k in range(len(got["pts"]))]


def test_broken_streams_are_noticed():
    raw = bytearray(media.write_stream(bytes(50_000)))
    with pytest.raises(ValueError):
        media.read_stream(bytes(raw[:100]))
    lost = bytes(raw[: 188 * 10] + raw[188 * 11 :])
    with pytest.raises(ValueError):
        media.read_stream(lost)
    bad = bytearray(raw)
    bad[20] ^= 1
    with pytest.raises(ValueError):
        media.read_stream(bytes(bad))
    swapped = bytes(raw[: 188 * 4] + raw[188 * 5 : 188 * 6] + raw[188 * 4 : 188 * 5] + raw[188 * 6 :])
    assert media.read_stream(swapped)["cc_errors"] > 0
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_media_query(spark, docs):
    rows = EDGE + [(11, "x"), (12, "x" * 64), (13, "x" * 65)]
    got = media.stream_features(media.text_media(docs(rows)), ["doc_id", "n_bytes"]).collect()
    assert len(got) == len(rows)
    texts = {(i, len((t or "").encode())): (t or "").encode() for i, t in rows}
    same = {}
    for r in got:
        raw = texts[r.doc_id, r.n_bytes]
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert same.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature) and "cc_errors=0" in r.feature
    assert media.stream_features(media.text_media(docs([])), ["doc_id", "n_bytes"]).count() == 0
    at = media.timestamps(media.text_media(docs([(1, "x" * 50_000), (None, None)]))).orderBy("doc_id", "unit").collect()
    assert [(r.doc_id, r.unit, r.pts, r.random_access) for r in at] == [(None, 0, 0, True), *((1, k, k * media.UNIT * 90_000 // media.RATE, k % media.RAP_EVERY == 0) for k in range(7))]
    assert media.timestamps(media.text_media(docs([]))).count() == 0

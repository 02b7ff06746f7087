import hashlib
import zlib

import pytest

from evograph.llm import warc

LONG = "<p>" + "x" * 1200


def rows():
    return [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (5, None, LONG), (5, "u", LONG), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "a b\r\nc", "é" * 3000), (None, "u", LONG), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 100)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(pages, with_body=True).collect()
    assert len(got) == len(rows())
    for r in got:
        payloads = {(h or "").encode() for i, _, h in rows() if i == r.page_id}
        payload = next(p for p in payloads if hashlib.sha1(p).hexdigest() == r.payload_digest)
        assert r.payload_bytes == len(payload)
        revisit = payload == LONG.encode() and r.page_id != 5
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (5 if revisit else None)
        assert r.body == (b"" if revisit else payload)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_normaliser_indexes_members(tmp_path):
    made = [warc.record(i, "u", bytes([65 + i]) * (i * 700_000), "d", None) for i in range(4)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.gz").write_bytes(z.compress(b"".join(made)) + z.flush())
    base = f"file://{tmp_path}"
    assert warc.normalise(f"{base}/a.gz", f"{base}/b.gz", f"{base}/b.idx") == 4
    assert [len(body) for _, body in warc.read_indexed(f"{base}/b.gz", f"{base}/b.idx")] == [0, 700_000, 1_400_000, 2_100_000]
    again = warc.normalise(f"{base}/b.gz", f"{base}/c.gz", f"{base}/c.idx")
    assert again == 4 and (tmp_path / "b.gz").read_bytes() == (tmp_path / "c.gz").read_bytes()
    for raw in (warc.member(made[1][:-9]), warc.member(made[1])[:-9], warc.member(made[1])[:-900]):
        (tmp_path / "cut.gz").write_bytes(raw)
        with pytest.raises(ValueError):
            warc.normalise(f"{base}/cut.gz", f"{base}/d.gz", f"{base}/d.idx")

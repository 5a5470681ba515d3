"""Archives of others, payloads that stay compressed, digests, filters, and the plan of revisits."""

import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql.datasource import EqualTo, In
from shapeloom.llm import warc

PAGES = [(k, f"http://h/{k}", f"<p>{'text ' * 40}{k % 7}") for k in range(20)]


def digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def foreign(body: bytes, kind: str = "response", uri: str = "http://f/", wrong: bool = False) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-Uri:{uri}\r\nX-Note: a\r\n b\r\nWARC-Payload-Digest: sha1:{digest(body + b'!' * wrong)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def rows(path, *filters, **how):
    r = warc.WarcReader(str(path), how.get("payload", True), how.get("partition_bytes", 1 << 20), how.get("verify", False))
    assert not list(r.pushFilters(list(filters)))
    return [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(tmp_path, packed):
    bodies = [b"", b"one", b"two" * 100_000, bytes(range(256)) * 300]
    records = [foreign(b, "response", f"http://f/{k}") for k, b in enumerate(bodies)] + [foreign(b"x", "metadata")]
    data = b"".join(gzip.compress(x) for x in records) if packed else b"".join(records)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / f"a.warc{'.gz' if packed else ''}").write_bytes(data)
    (tmp_path / "notes.txt").write_text("no")
    got = rows(tmp_path, verify=True)
    assert [x["payload"] for x in got] == [*bodies, None] and [x["payload_length"] for x in got] == [*map(len, bodies), -1]
    assert [x["target_uri"] for x in got][:4] == [f"http://f/{k}" for k in range(4)] and got[1]["payload_digest"] == digest(b"one")
    assert len(rows(tmp_path, EqualTo(("record_type",), "metadata"))) == 1 and len(rows(tmp_path, In(("target_uri",), ("http://f/1", "http://f/3")))) == 2
    assert [x["payload_length"] for x in rows(tmp_path, EqualTo(("target_uri",), "http://f/2"), payload=False)] == [300_000]


def test_a_wrong_digest_is_found(tmp_path):
    (tmp_path / "a.warc").write_bytes(foreign(b"body", wrong=True))
    assert rows(tmp_path)[0]["payload"] == b"body"
    with pytest.raises(ValueError, match="digest"):
        rows(tmp_path, verify=True)
    (tmp_path / "a.warc").write_bytes(foreign(b"body")[:-8])
    with pytest.raises(ValueError, match="cut off"):
        rows(tmp_path)


def test_unwanted_payloads_stay_compressed(tmp_path):
    body = "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(2000)).encode()
    good = warc.member(warc.record("response", "<urn:page:1>", "http://a/", digest(body), body, None, len(body)))
    broken = bytearray(good)
    broken[len(good) // 2] ^= 0xFF  # inflating this payload fails
    broken[len(good) // 2 + 1] ^= 0xFF
    other = warc.member(warc.record("revisit", "<urn:page:2>", "http://a/", digest(body), None, "<urn:page:1>", len(body)))
    (tmp_path / "a.warc.gz").write_bytes(bytes(broken) + other + good)
    assert [x["record_id"] for x in rows(tmp_path, EqualTo(("record_type",), "revisit"))] == ["<urn:page:2>"]
    assert [x["payload_length"] for x in rows(tmp_path, payload=False)] == [len(body)] * 3
    with pytest.raises((zlib.error, ValueError)):
        rows(tmp_path)


@pytest.mark.parametrize("most", [250_000, 0])
def test_plan_of_revisits(spark, most):
    got = warc.planned(spark.createDataFrame([*PAGES, (None, "u", PAGES[0][2])], "page_id long, url string, html string"), broadcast_rows=most).collect()
    last = {}
    for k, _, t in PAGES:
        last[t] = max(k, last.get(t, -1))
    want = {(f"<urn:page:{k}>", "response" if last[t] == k else "revisit", None if last[t] == k else f"<urn:page:{last[t]}>") for k, _, t in PAGES} | {(None, "revisit", f"<urn:page:{last[PAGES[0][2]]}>")}
    assert {(r.record_id, r.record_type, r.refers_to) for r in got} == want


def test_appended_archives_hold_all_commits(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = f"file://{tmp_path}/many"
    for lo, hi in ((0, 8), (8, 9), (9, 20)):
        warc.archive(pages.where(f"page_id >= {lo} and page_id < {hi}"), path)
    got = spark.read.format("warc").load(path)
    assert sorted(r.target_uri for r in got.select("target_uri").collect()) == sorted(u for _, u, _ in PAGES)
    before = len(list((tmp_path / "many").glob("*.gz")))
    warc.planned(pages.where("page_id < 3")).write.format("warc").mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == 3 and len(list((tmp_path / "many").glob("*.gz"))) < before and len(list((tmp_path / "many").glob("MANIFEST*"))) == 1


def test_a_list_of_an_earlier_writer(tmp_path):
    (tmp_path / "a.warc").write_bytes(foreign(b"a"))
    (tmp_path / "b.warc").write_bytes(foreign(b"b"))
    (tmp_path / "MANIFEST").write_text("a.warc\n")
    assert [x["payload"] for x in rows(tmp_path)] == [b"a"]
    (tmp_path / "MANIFEST-1").write_text("b.warc\n")
    assert [x["payload"] for x in rows(tmp_path)] == [b"a", b"b"]


def test_large_payloads_take_linear_time(tmp_path):
    import os
    import time

    took = []
    for mb in (32, 256):
        body = os.urandom(1 << 20) * mb  # beyond the window of deflate: not compressed
        (tmp_path / str(mb)).mkdir()
        (tmp_path / str(mb) / "x.warc.gz").write_bytes(warc.member(warc.record("response", "r", "u", digest(body), body, None, len(body))))
        began = time.time()
        (got,) = rows(tmp_path / str(mb), verify=True)
        took.append(time.time() - began)
        assert got["payload"] == body
    assert took[1] < 20 and took[1] < 24 * max(took[0], 0.1)

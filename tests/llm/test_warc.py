"""Archives: what is written is read back whatever the ranges, and damage costs no other record."""

import base64
import gzip
import hashlib
import io
import os
import random

import pyarrow as pa
import pytest

from quillmark.llm import warc


def by_hand(data: bytes) -> list[tuple[int, str, bytes]]:
    """(start, type, block) of each member, by gzip alone."""
    out, at = [], 0
    while at < len(data):
        d = warc.zlib.decompressobj(31)
        text = d.decompress(data[at:])
        head, _, block = text.partition(b"\r\n\r\n")
        n = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert block[n:] == b"\r\n\r\n"
        out.append((at, head.split(b"WARC-Type: ")[1].split(b"\r\n")[0].decode(), block[:n]))
        at = len(data) - len(d.unused_data)
    return out


def row(i, payload, kind="response"):
    return {"record_id": f"urn:page:{i}:x", "uri": f"http://a/{i}", "record_type": kind, "refers_to": "urn:page:9:x" if kind == "revisit" else None, "payload": payload, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()}


@pytest.fixture(scope="module")
def archive():
    rng = random.Random(1)
    inner = b"".join(b"".join(warc.member(warc.record(row(900 + k, rng.randbytes(50)), "d"))) for k in range(3))
    payloads = [b"", b"x", "wörd <html>".encode() * 40, rng.randbytes(3000), inner * 4, warc.MAGIC * 3, b"\r\n\r\n" * 5, b"a" * 200_000]
    rows = [row(i, p) for i, p in enumerate(payloads)] + [row(99, b"gone", "revisit")]
    return rows, [b"".join(warc.member(warc.record(r, "2024-01-01T00:00:00Z"))) for r in rows]


def parts(data, step, payload=True):
    f = pa.BufferReader(data)
    return [list(warc.records(f, len(data), at, at + step, payload)) for at in range(0, len(data), step)]


def test_members_are_plain_gzip(archive):
    rows, members = archive
    data = b"".join(members)
    assert [k for _, k, _ in by_hand(data)] == ["response"] * 8 + ["revisit"]
    assert b"WARC/1.1" in gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    for (_, kind, block), r in zip(by_hand(data), rows, strict=True):
        assert block.split(b"\r\n\r\n", 1)[1] == (r["payload"] if kind == "response" else b"")


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 4096, 1 << 20])
def test_any_range(archive, step):
    """Every record is read once, by the range that it begins in; archives inside payloads are never taken for records."""
    rows, members = archive
    data = b"".join(members) if step > 1 else b"".join(members[:4])
    found = parts(data, step)
    got = [r for p in found for r in p]
    assert [r["start"] for r in got] == [at for at, _, _ in by_hand(data)]
    assert all(n * step <= r["start"] < (n + 1) * step for n, p in enumerate(found) for r in p)
    for r, want in zip(got, rows, strict=False):
        digest = base64.b32encode(hashlib.sha1(want["payload"]).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"], r["error"]) == (len(want["payload"]), digest, None)
        assert r["payload"] == (want["payload"] if r["record_type"] == "response" else None)


@pytest.mark.parametrize("step", [50, 500, 1 << 20])
def test_damage(archive, step):
    """A broken member, junk between members and a cut end give one row each; all other records are read."""
    _, members = archive
    broken = members[2][:60] + bytes([members[2][60] ^ 255]) + members[2][61:]
    data = b"junk" + members[0] + members[1] + broken + members[3] + b"\x1f\x8b\x08 junk" + members[5] + members[2][:-3]
    got = [r for p in parts(data, step) for r in p]
    assert sum(r.get("error") == "damaged" for r in got) == 4
    assert [r["record_id"] for r in got if "record_id" in r] == [f"urn:page:{i}:x" for i in (0, 1, 3, 5)]


def test_changed_payload_is_told(archive):
    text = gzip.decompress(archive[1][1]).replace(b"\r\n\r\nx\r\n", b"\r\n\r\ny\r\n")
    (found,) = parts(gzip.compress(text), 1 << 20)[0]
    assert found["error"] == "digest_mismatch" and found["payload"] == b"y"


def test_foreign_records(archive):
    """Records that are no HTTP, folded headers, members that are no WARC."""
    text = b"WARC/1.0\r\nWARC-Type: metadata\r\nwarc-record-id: <urn:x>\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(b"no record") + gzip.compress(text) + gzip.compress(b"")
    got = [r for p in parts(data, 10) for r in p]
    assert [(r.get("record_id"), r.get("payload"), r.get("error")) for r in got] == [(None, None, "damaged"), ("urn:x", b"abc", None), (None, None, "damaged")]


def expected(rows, least):
    """(id, payload, type, refers_to) by hand."""
    best, out = {}, []
    key = lambda i: (i is not None, i or 0)
    for i, p in rows:
        best[p] = max(best.get(p, (False, 0)), key(i))
    taken = set()
    for i, p in sorted(rows, key=lambda r: (key(r[0]), r[1])):
        if len(p) < least:
            out.append((i, p, "response", None))
        elif key(i) == best[p] and p not in taken:
            taken.add(p)
            out.append((i, p, "response", None))
        else:
            out.append((i, p, "revisit", best[p][1] if best[p][0] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 4])
def test_pages(spark, tmp_path, least):
    rng = random.Random(2)
    texts = ["", "abc", "<p>ü</p>", "long " * 5000, "\x1f", "x\r\n\r\ny"]
    pages = [(i, f"http://e/{i}\r\nX: 1", rng.choice(texts), "k", 1) for i in range(80)] + [(200 + i, None, f"only {i}", "k", 1) for i in range(20)]
    pages += [pages[3]] * 3 + [(None, None, "abc", "k", 1), (None, None, None, "k", 1), (None, "u", None, "k", 1), (7, "other", "alone", "k", 1)] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha string, k int").repartition(3)
    warc.write(warc.records_of(df, least=least), str(tmp_path / "a"), file_bytes=5000)
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")]) > 4
    (tmp_path / "a" / "lost.warc.gz").write_bytes(b"left by a lost task")
    found = warc.read(spark, str(tmp_path / "a"), range_bytes=700).collect()
    assert not any(r.error for r in found)
    assert len({r.record_id for r in found}) == len(found)
    page = lambda u: int(u.split(":")[2]) if u and u.split(":")[2] else None
    by_id = {r.record_id: bytes(r.payload) for r in found if r.record_type == "response"}
    got = [(page(r.record_id), bytes(r.payload) if r.record_type == "response" else by_id[r.refers_to], r.record_type, page(r.refers_to)) for r in found if r.record_type != "warcinfo"]
    assert sorted(got, key=repr) == expected([(i, (h or "").encode()) for i, _, h, *_ in pages], least)
    for r in found:
        if r.record_type == "revisit":
            assert (r.payload_bytes, r.payload_digest) == (len(by_id[r.refers_to]), base64.b32encode(hashlib.sha1(by_id[r.refers_to]).digest()).decode())


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.records_of(df), str(tmp_path / "a"))
    assert warc.read(spark, f"file://{tmp_path}/a", payload="false").count() == 0

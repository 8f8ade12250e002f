import awkward
import numpy as np
import pytest

from tarnfold.llm import warc as W


def brute(data: bytes):
    """Offsets of the records, read one after another."""
    out, at = [], 0
    while data[at : at + 7] == b"WARC/1.":
        stop = data.index(b"\r\n\r\n", at)
        head = W.headers_of(data[at:stop])
        end = stop + 4 + int(head["content-length"])
        if end > len(data):
            break
        out.append(at)
        at = end + 4
    return out


def file_of(n=40, seed=1):
    r = np.random.default_rng(seed)
    fake = W.record_bytes("response", 5, "http://x", b"inner")
    parts = []
    for i in range(n):
        body = b"\n".join([r.bytes(int(r.integers(0, 400))), *([fake] if i % 3 == 0 else []), b"WARC/1.0\r\ncontent-length: 3\r\n\r\nabc" * (i % 4)])
        parts.append(W.record_bytes("resource", i, f"http://e/{i}", body))
    return b"".join(parts)


def test_magic_in_payloads(spark, tmp_path):
    data = file_of()
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(data[: len(data) // 2])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"no record WARC/1.0\r\n")
    for size in (100, 1000, 1 << 20):
        got = {}
        for r in W.read_files(spark, str(tmp_path), size).collect():
            got.setdefault(r.path[-6:], []).append(r)
        assert sorted(got) == ["a.warc", "b.warc"]
        for name, whole in (("a.warc", data), ("b.warc", data[: len(data) // 2])):
            rows = sorted(got[name], key=lambda r: r.offset)
            assert [r.offset for r in rows] == brute(whole)
            for i, r in enumerate(rows):
                assert r.url == f"http://e/{i}" and r.record_id == f"<urn:page:{i}>" and whole[r.offset :].startswith(b"WARC/1.1") and r.headers["warc-type"] == "resource"


def test_pointer_jumping():
    r = np.random.default_rng(0)
    for _ in range(50):
        offset = np.unique(np.append(r.integers(0, 200, 30), 0))
        after = offset + r.integers(1, 20, len(offset))
        want, at = set(), 0
        while at in offset:
            want.add(at)
            at = int(after[np.searchsorted(offset, at)])
        assert set(offset[W.reachable(offset, after)].tolist()) == want
    assert W.reachable(np.array([3]), np.array([9])).tolist() == [False] and len(W.reachable(np.zeros(0, int), np.zeros(0, int))) == 0


def test_round_trip_of_awkward_rows(spark, tmp_path):
    df = awkward.frame(spark).withColumnRenamed("source", "url")
    W.write_files(df, f"file://{tmp_path}/w", "doc_id", "url", "text")
    rows = [r for r in W.read_files(spark, f"{tmp_path}/w", 5000).collect() if r.warc_type == "resource"]
    got = sorted((str(r.record_id and int(r.record_id[10:-1])), str(r.url), bytes(r.content)) for r in rows)
    assert got == sorted((str(r[0]), str(r[3]), (r[1] or "").encode()) for r in awkward.rows())
    W.write_files(awkward.empty(spark).withColumnRenamed("source", "url"), f"file://{tmp_path}/e", "doc_id", "url", "text")
    with pytest.raises(ValueError):
        W.write_files(df, f"file://{tmp_path}/x")


def test_headers():
    head = W.headers_of(b"WARC/1.0\r\nWARC-Type: a\r\nX: one\r\n two\r\nx: late\r\n more\r\nbad line")
    assert head == {"warc-type": "a", "x": "one two"}


def test_long_headers_versions_and_broken_files(spark, tmp_path):
    """A header of 300 KB that crosses ranges, an old and a new version; a file with a record that breaks a rule is named."""
    long_ = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: " + b"a" * 300_000 + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    old = b"WARC/0.18\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    new = b"WARC/2.0\r\nWARC-Type: resource\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(old + long_ + new)
    (tmp_path / "b.warc").write_bytes(old + b"WARC/1.1\r\nContent-Length: x\r\n\r\n" + old)
    got = sorted((r.path.rpartition("/")[2], r.offset, bytes(r.content)) for r in W.read_files(spark, str(tmp_path), range_bytes=1000).collect())
    assert got == [("a.warc", 0, b"hi"), ("a.warc", len(old), b"abc"), ("a.warc", len(old + long_), b""), ("b.warc", 0, b"hi")]
    assert [(r.path.rpartition("/")[2], r.read_until) for r in W.broken_files(spark, str(tmp_path)).collect()] == [("b.warc", len(old))]

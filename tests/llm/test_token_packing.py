import awkward
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import token_packing as T


@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 64))
@settings(max_examples=80, deadline=None)
def test_best_fit(sizes, room):
    sizes = sorted(sizes, reverse=True)
    left, want = [], []
    for i, s in enumerate(sizes):
        fits = [(r, k) for k, r in enumerate(left) if r >= s]
        if fits:
            _, k = min(fits)
            left[k] -= s
            want[k].append(i)
        else:
            left.append(room - s)
            want.append([i])
    assert T.best_fit(sizes, room) == want


def check(rows, texts, row_tokens):
    enc, got = T.load_encoding(), {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == row_tokens and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == T.PAD_ID).all()
        for a, b, d, o in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets):
            assert pos[a:b].tolist() == list(range(b - a))
            got.setdefault(d, []).append((o, ids[a:b].tolist()))
    want = {}
    for d, t in texts:
        if t:
            want.setdefault(d, []).extend(enc.encode_ordinary(t))
    assert {d: sorted(sum((x for _, x in sorted(p)), [])) for d, p in got.items()} == {d: sorted(x) for d, x in want.items()}
    one = {d for d, _ in texts if [x for x, _ in texts].count(d) == 1}
    for d in one & set(want):
        assert sum((x for _, x in sorted(got[d])), []) == want[d]


def test_round_trip(spark):
    data = [awkward.row(i, awkward.prose(i, i * 13 % 700)) for i in range(60)]
    rows = T.pack_tokens(awkward.frame(spark, data), row_tokens=256).collect()
    check(rows, [(r[0], r[1]) for r in data], 256)
    full = sum(r.n_tokens for r in rows)
    assert full / (256 * len(rows)) > 0.9


def test_awkward_empty_and_files(spark, tmp_path):
    df = awkward.frame(spark)
    packed = T.pack_tokens(df)
    rows = packed.collect()
    check(rows, [(r[0], r[1]) for r in awkward.rows()], T.ROW_TOKENS)
    files = T.write_matrices(packed, f"file://{tmp_path}/m").collect()
    ids = b"".join((tmp_path / "m" / (f.path.rpartition("/")[2] + ".ids.bin")).read_bytes() for f in files)
    assert sorted(ids[i : i + 4096] for i in range(0, len(ids), 4096)) == sorted(bytes(r.input_ids) for r in rows)
    lens = np.concatenate([np.frombuffer((tmp_path / "m" / (f.path.rpartition("/")[2] + ".seqlens.bin")).read_bytes(), "<u4") for f in files if f.n_rows])
    assert len(lens) == sum(len(r.cu_seqlens) for r in rows)
    assert T.pack_tokens(awkward.empty(spark)).count() == 0
    assert T.write_matrices(T.pack_tokens(awkward.empty(spark)), f"file://{tmp_path}/e").agg({"n_rows": "sum"}).first()[0] in (0, None)


def test_special_strings_are_text(spark):
    rows = T.pack_tokens(awkward.frame(spark, [awkward.row(1, "a <|endoftext|> b")])).collect()
    check(rows, [(1, "a <|endoftext|> b")], T.ROW_TOKENS)


def test_missing_column(spark):
    with pytest.raises(ValueError):
        T.pack_tokens(awkward.frame(spark), text_col="nothing")

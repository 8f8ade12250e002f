import pyarrow as pa

from tarnfold.llm.text_kernel import SLICE_ROWS, slices


def test_slices_hold_few_rows_and_bytes():
    """A million empty texts come in pieces of bounded rows, without loss, as do short, null and long ones."""
    empty = [pa.record_batch({"text": pa.array([""] * 10_000), "n": range(i, i + 10_000)}) for i in range(0, 1_000_000, 10_000)]
    sizes = [(p.num_rows, p.column("n")[0].as_py()) for p in slices(iter(empty), "text")]
    assert max(n for n, _ in sizes) <= SLICE_ROWS and sum(n for n, _ in sizes) == 1_000_000 and [x for _, x in sizes] == sorted(x for _, x in sizes)
    mixed = [pa.record_batch({"text": pa.array(["x" * 50, None, "", "y" * 3000, "z"])}) for _ in range(40)]
    out = [p.column("text").to_pylist() for p in slices(iter(mixed), "text", limit=1000, rows=7)]
    assert max(map(len, out)) <= 7 and [x for p in out for x in p] == ["x" * 50, None, "", "y" * 3000, "z"] * 40
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 1000 for p in out)

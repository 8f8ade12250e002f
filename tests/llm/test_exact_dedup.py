import awkward
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import exact_dedup as X


@given(st.lists(st.integers(0, (1 << 48) - 1), max_size=200), st.booleans())
@settings(max_examples=60, deadline=None)
def test_rice_round_trip(values, close):
    v = np.sort(np.array([x % 50 for x in values] if close else values, np.uint64))
    assert X.rice_decode(X.rice_encode(v)).tolist() == v.tolist()


def brute(rows):
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r[0])
    out = []
    for ids in groups.values():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0]) for i in ids[1:]]
    return sorted(out, key=str)


def test_awkward_rows(spark):
    df = awkward.frame(spark)
    got = sorted(((r.doc_id, r.duplicate_of) for r in X.find_copies(df).collect()), key=str)
    assert got == brute(awkward.rows())
    kept = X.drop_copies(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == df.count() - len(got)
    assert sum(r.text is None for r in rows) == 2
    assert all(r["a.b"] == "dot" for r in rows)


def test_scan_of_files_and_owners(spark, tmp_path):
    data = [awkward.row(i, awkward.prose(i % 37, 20)) for i in range(300)]
    awkward.frame(spark, data).repartition(7).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for owners in (1, 5):
        got = sorted(((r.doc_id, r.duplicate_of) for r in X.find_copies(df, owners=owners).collect()), key=str)
        assert got == brute(data)


def test_empty(spark):
    assert X.find_copies(awkward.empty(spark)).count() == 0
    assert X.drop_copies(awkward.empty(spark)).count() == 0


def test_cores_that_change_between_the_scans(spark, tmp_path):
    """Files are cut by the cores that are there; a scan with fewer of them must find its lists all the same."""
    data = [awkward.row(i, awkward.prose(i % 37, 20)) for i in range(300)]
    awkward.frame(spark, data).repartition(7).write.parquet(str(tmp_path / "d"))
    cores, pinned = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"
    before = spark.conf.get(pinned, None)
    try:
        for op in (X.find_copies, X.drop_copies):
            spark.conf.unset(pinned)
            spark.conf.set(cores, "8")
            out = op(spark.read.parquet(str(tmp_path / "d")))
            spark.conf.set(cores, "1")
            if op is X.find_copies:
                assert sorted(((r.doc_id, r.duplicate_of) for r in out.collect()), key=str) == brute(data)
            else:
                assert sorted(r.doc_id for r in out.collect()) == list(range(37))
    finally:
        spark.conf.unset(cores)
        spark.conf.unset(pinned)
        if before is not None:
            spark.conf.set(pinned, before)

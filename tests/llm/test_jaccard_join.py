import itertools
import random

import awkward
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnfold.llm import jaccard_join as J
from tarnfold.llm.text_kernel import Words


def grams(text, n=J.NGRAM):
    w = Words(pa.array([text], pa.string()))
    x = [w.text(i) for i in range(len(w))]
    return {tuple(x[i : i + n]) for i in range(max(1, len(x) - n + 1))} if x else set()


def brute(rows, threshold):
    held = [(r[0], grams(r[1])) for r in rows if r[0] is not None and r[1]]
    out = set()
    for (a, x), (b, y) in itertools.combinations([h for h in held if h[1]], 2):
        if a != b and len(x & y) >= threshold * len(x | y):
            out.add((min(a, b), max(a, b)))
    return out


def pairs(found):
    across, members = found
    of = {}
    for r in members.collect():
        of.setdefault(r.representative, set()).add(r.doc_id)
    out = {(a, b) for held in of.values() for a in held for b in held if a < b}
    for r in across.collect():
        assert r.doc_id < r.other_id
        out |= {(min(a, b), max(a, b)) for a in of[r.doc_id] for b in of[r.other_id] if a != b}
    return out


def groups_of(links):
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def near_copies(groups=25, words=80, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    data, i = [], 0
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 10, words, 3 * words]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            w = [r.choice(vocabulary) if r.random() < r.choice([0, 0.02, 0.1]) else x for x in base]
            data.append(awkward.row(i, " ".join(w) if r.random() < 0.8 else " ".join(w).upper() + "!"))
            i += 1
    return data


def test_against_brute_force(spark):
    data = near_copies()
    df = awkward.frame(spark, data)
    for threshold in (0.5, 0.8):
        want, got = brute(data, threshold), pairs(J.similar_pairs(df, threshold=threshold))
        assert got <= want
        assert len(got) >= 0.97 * len(want)


def test_nodes_too_big_for_a_task(spark):
    """A small node limit sends nodes through the shuffled levels and, as copies can't be split, through pairs of blocks."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 999)}" for _ in range(60)]
    data = [awkward.row(i, " ".join([*base[: 50 + i % 9], f"x{i}", f"y{i}"])) for i in range(90)]
    df = awkward.frame(spark, data)
    want = brute(data, 0.5)
    got = pairs(J.similar_pairs(df, node_limit=20))
    assert got <= want and len(got) >= 0.97 * len(want) > 1000


def test_tree_below_a_node():
    """In-task recursion over one node with many unrelated sets and a few groups."""
    r = np.random.default_rng(2)
    sig = r.integers(0, 256, (1500, J.POSITIONS)).astype(np.uint8)
    for k in range(0, 300, 3):
        for j in (1, 2):
            same = r.random(J.POSITIONS) < 0.85
            sig[k + j, same] = sig[k, same]
    a, b = J.compare_nodes(np.zeros(1500, np.uint64), sig, 40, 0.7)
    want = {(i, j) for i in range(300) for j in range(i + 1, min(i + 3, 300)) if (sig[i] == sig[j]).sum() >= 40}
    runs = set(zip(a.tolist(), b.tolist()))
    for seed in range(1, 6):
        a, b = J.compare_nodes(np.full(1500, seed, np.uint64), sig, 40, 0.7)
        runs |= set(zip(a.tolist(), b.tolist()))
    assert runs <= want and len(runs) >= 0.97 * len(want)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    data = near_copies(seed=5)
    df = awkward.frame(spark, data)
    kept = J.keep_one(df)
    assert kept.schema == df.schema
    left = {r.doc_id for r in kept.collect()}
    want = pairs(J.similar_pairs(df))
    group = groups_of(want)
    assert left == {r[0] for r in data if group.get(r[0], r[0]) == r[0]}


def test_linked_documents(spark, monkeypatch):
    """Rows, groups and counts against brute force; a group of 300 copies, and verification in many small blocks."""
    data = near_copies(seed=6) + [awkward.row(5000 + i, awkward.prose(77, 40)) for i in range(300)]
    text, want = {r[0]: grams(r[1]) for r in data}, brute(data, 0.5)
    group = groups_of(want)
    for block in (J.BLOCK, 3):
        monkeypatch.setattr(J, "BLOCK", block)
        got = {r.doc_id: tuple(r)[1:] for r in J.linked_documents(awkward.frame(spark, data)).collect()}
        counts = {x: [0, 0] for x in group}
        for a, b in want:
            for x in (a, b):
                counts[x][text[a] != text[b]] += 1
        assert got == {x: (group[x], *counts[x]) for x in group}


def test_awkward_and_empty(spark):
    df = awkward.frame(spark)
    assert pairs(J.similar_pairs(df)) == brute(awkward.rows(), 0.5)
    kept = J.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 9, 10, 12, 14, 15, 16, 17]
    assert sum(r.doc_id is None for r in kept) == 2
    assert [x.count() for x in J.similar_pairs(awkward.empty(spark))] == [0, 0]
    assert J.linked_documents(awkward.empty(spark)).count() == 0
    assert {r.doc_id for r in J.linked_documents(df).collect()} == {x for p in brute(awkward.rows(), 0.5) for x in p}
    assert J.keep_one(awkward.empty(spark)).count() == 0


def test_cores_that_change_between_the_scans(spark, tmp_path):
    data = near_copies(seed=5)
    awkward.frame(spark, data).repartition(7).write.parquet(str(tmp_path / "d"))
    want = {r.doc_id for r in J.keep_one(awkward.frame(spark, data)).collect()}
    cores, pinned = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"
    before = spark.conf.get(pinned, None)
    try:
        spark.conf.unset(pinned)
        spark.conf.set(cores, "8")
        out = J.keep_one(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set(cores, "1")
        assert {r.doc_id for r in out.collect()} == want
    finally:
        spark.conf.unset(cores)
        spark.conf.unset(pinned)
        if before is not None:
            spark.conf.set(pinned, before)


def alike(n, share, seed):
    """n signatures that keep about `share` of the positions of one."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 256, J.POSITIONS)
    return np.where(r.random((n, J.POSITIONS)) < share, base, r.integers(0, 256, (n, J.POSITIONS))).astype(np.uint8)


def test_a_large_group_comes_in_pieces(monkeypatch):
    """However many pairs a node has, no piece holds more than PIECE, and none of them is lost."""
    monkeypatch.setattr(J, "PIECE", 5000)
    sig = np.concatenate([alike(700, 0.9, 1), alike(30, 0.9, 2)])
    n = len(sig)
    cid, node = np.random.default_rng(3).permutation(n), np.repeat([5, 9], [700, 30])
    table = pa.record_batch({"run": pa.array(np.zeros(n, np.int32)), "node": node, "cid": cid, "group": cid, "sig": pa.array([x.tobytes() for x in sig], pa.binary())})
    out = list(J._compare(0.5, 20)([table]))
    assert max(b.num_rows for b in out) <= 5000 < sum(b.num_rows for b in out)
    got = {(a, b) for t in out for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())}
    agree = (sig[:, None] == sig[None]).sum(axis=2) >= 20
    i, j = np.nonzero(np.triu(agree & (node[:, None] == node[None]), 1))
    assert got == {(int(min(cid[x], cid[y])), int(max(cid[x], cid[y]))) for x, y in zip(i, j)}


def test_pairs_across_groups_only():
    """Rows of one group are not paired, all others are; a star has fewer pairs than rows, and links most rows that are alike."""
    sig = alike(300, 0.9, 4)
    node, group = np.zeros(300, np.uint64), np.arange(300) // 290 * np.arange(300)
    a, b = J.compare_nodes(node, sig, 20, 0.5, group=group)
    i, j = np.nonzero(np.triu(((sig[:, None] == sig[None]).sum(axis=2) >= 20) & (group[:, None] != group[None]), 1))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(i.tolist(), j.tolist()))
    a, b = J.star_pairs(node, sig, 32, 0.5)
    assert 290 <= len(set(b.tolist())) == len(b) < 300 and not set(a.tolist()) & set(b.tolist())


def test_keep_one_looks_at_few_pairs_of_a_large_group(spark, monkeypatch):
    """300 near copies and a chain that leads out of them: one is kept of all, without the 44,850 pairs of the copies."""
    base = awkward.prose(1, 120).split()
    texts = []
    for i in range(300):
        w = list(base)
        w[i % 120] = f"x{i}"
        texts.append(" ".join(w))
    # a bridge shares half with a copy and half with one text further on
    tail = [f"y{i}" for i in range(60)]
    texts += [" ".join(base[25:] + tail[:30]), " ".join(base[60:] + tail), awkward.prose(7, 80)]
    data = [awkward.row(i, t) for i, t in enumerate(texts)]
    looked = []
    whole = J._verified
    monkeypatch.setattr(J, "_verified", lambda d, c, candidates, *rest: (looked.append(candidates.count()), whole(d, c, candidates, *rest))[1])
    kept = {r.doc_id for r in J.keep_one(awkward.frame(spark, data)).collect()}
    links = brute(data, 0.5)
    root = list(range(len(data)))
    for _ in data:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert kept == {i for i, r in enumerate(root) if i == r} and len(kept) < 4
    assert sum(looked) < 10 * len(data)

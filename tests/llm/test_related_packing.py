import pickle
import random
import types

import awkward
import numpy as np
import pyarrow as pa

from tarnfold.llm import related_packing as R


def lossless(data, windows, size):
    want = sorted(((r[0], n) for r, n in data), key=str)
    pieces = {}
    for w in windows:
        assert sum(w.n_words) <= size and len(w.doc_ids) == len(w.first_words) == len(w.n_words)
        for i, f, n in zip(w.doc_ids, w.first_words, w.n_words):
            pieces.setdefault(i, []).append((f, n))
    got = []
    for i, p in pieces.items():
        p.sort()
        total = 0
        for f, n in p:
            if f == 0 and total:
                got.append((i, total))
                total = 0
            total += n
        got.append((i, total))
    assert sum(n for _, n in got) == sum(n for _, n in want)
    assert {i for i, _ in got} == {i for i, _ in want}


def words(text):
    import pyarrow as pa

    return len(R.Words(pa.array([text], pa.string())))


def test_nearest():
    """All pairs of sparse rows, with frequent and rare words, against a dense product."""
    rng = np.random.default_rng(3)
    dense = np.zeros((2500, 400), np.float32)
    for i in range(2500):
        dense[i, np.unique((rng.random(30) ** 2 * 400).astype(int))] = 1
    dense[:40] = 0
    dense *= rng.random(dense.shape) + 0.1
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    row, word = np.nonzero(dense)
    r, o, s = R.nearest(np.searchsorted(row, np.arange(2501)), word.astype(np.uint32), dense[row, word], 5)
    sim = dense @ dense.T
    np.fill_diagonal(sim, -1)
    assert (r[1:] >= r[:-1]).all() and (r != o).all() and np.allclose(sim[r, o], s, atol=1e-5)
    want = np.sort(sim, axis=1)[:, -5:]
    assert np.bincount(r, minlength=2500).tolist() == (want > 0).sum(axis=1).tolist()
    assert np.allclose(np.sort(s), np.sort(want[want > 0]), atol=1e-5)


def test_blocks_of_a_cell(monkeypatch):
    """However batches fall, each row is searched once, blocks hold under 2 * cell_rows rows, and cells don't mix."""
    sizes = []
    monkeypatch.setattr(R, "nearest", lambda first, *_: (sizes.append(len(first) - 1), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.float32))[1:])
    for lens, step in (([25, 3, 60], 7), ([1, 100], 100), ([40], 3)):
        sizes.clear()
        cell = np.repeat(np.arange(len(lens)), lens)
        t = pa.record_batch({"turn": pa.array(np.zeros(len(cell), np.int32)), "cell": cell, "rid": np.arange(len(cell)), "vector": pa.array([b"1234"] * len(cell), pa.binary())})
        out = pa.Table.from_batches(list(R._search(5, 20)(t.slice(i, step) for i in range(0, len(cell), step))))
        assert sorted(out.column("rid").to_pylist()) == list(range(len(cell))) and max(sizes) < 40 and sum(sizes) == len(cell)
        block = dict(zip(out.column("rid").to_pylist(), out.column("block").to_pylist()))
        assert len({(b, int(cell[r])) for r, b in block.items()}) == len(set(block.values())) == len(sizes)


def test_joined_paths(spark):
    """Each path has one before and one after it at most, by an edge between its ends; places along chains add up."""
    r = random.Random(2)
    n = 400
    paths = [(i % 7, 2 * i, i // 7, 2 * i + 1, r.randint(0, 4), r.randint(1, 9)) for i in range(n)]
    edges = {}
    for _ in range(2500):
        a, b = r.randrange(2 * n), r.randrange(2 * n)
        if a != b:
            edges.setdefault(a, {})[b] = float(r.randint(1, 9)) / 10
    best = spark.createDataFrame([(a, list(e), list(e.values())) for a, e in edges.items()], "rid long, others array<long>, sims array<float>")
    df = spark.createDataFrame(paths, "block long, path long, seq long, tail long, degree long, path_words long")
    joins = R._joins(df, best)
    got = {x.path: x.next for x in joins.collect()}
    key, words = {p[1]: (p[4], p[1]) for p in paths}, {p[1]: p[5] for p in paths}
    linked = {(a, b) for a, e in edges.items() for b in e} | {(b, a) for a, e in edges.items() for b in e}
    assert len(set(got.values())) == len(got) > 50
    assert all((a + 1, b) in linked and key[a] < key[b] for a, b in got.items())
    # nothing that could still be joined is left
    assert not [(a, b) for a in words if a not in got for b in words if b not in got.values() and (a + 1, b) in linked and key[a] < key[b]]
    starts = {x.path: (x.home, x.start) for x in R._starts(df, joins).collect()}
    want = {}
    for block in range(7):
        at = 0
        for p in sorted((p for p in paths if p[0] == block and p[1] not in got.values()), key=lambda p: p[2]):
            x = p[1]
            while x is not None:
                want[x] = (block, at)
                at += words[x]
                x = got.get(x)
    assert starts == want


def test_walk():
    """Low degree first, the nearest unvisited neighbour next, as a plain version does it."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        m = int(rng.integers(0, 60)) if n > 1 else 0
        edges = {}
        for a, b in rng.integers(0, n, (m, 2)).tolist():
            if a != b:
                edges[min(a, b), max(a, b)] = float(np.float32(rng.integers(0, 5) / 5))
        near = {i: {} for i in range(n)}
        for (a, b), s in edges.items():
            near[a][b] = near[b][a] = s
        left, want = set(range(n)), []
        while left:
            at = min(left, key=lambda i: (len(near[i]), i))
            while at is not None:
                left.discard(at)
                want.append(at)
                at = min((j for j in near[at] if j in left), key=lambda j: (-near[at][j], j), default=None)
        e = np.array(list(edges)).reshape(-1, 2)
        got, _ = R.walk(n, e[:, 0], e[:, 1], np.array(list(edges.values()), np.float32))
        assert [x for p in got for x in p] == want


def test_copies_lie_together(spark):
    data = [awkward.row(i, awkward.prose(i % 200, 50)) for i in range(400)]
    out = R.pack(awkward.frame(spark, data), window_words=500).collect()
    lossless([(r, words(r[1])) for r in data], out, 500)
    order = [i for w in sorted(out, key=lambda w: (w.cell, w.window)) for i in w.doc_ids]
    order = [i for k, i in enumerate(order) if not k or order[k - 1] != i]
    at = {i: k for k, i in enumerate(order)}
    assert sum(abs(at[i] - at[i + 200]) <= 2 for i in range(200)) >= 170


def test_awkward_many_cells_and_empty(spark):
    data = awkward.rows()
    out = R.pack(awkward.frame(spark), window_words=1000, cell_rows=3).collect()
    lossless([(r, words(r[1])) for r in data], out, 1000)
    assert R.pack(awkward.empty(spark)).count() == 0
    assert R.pack(awkward.frame(spark, [awkward.row(1, None)])).collect()[0].doc_ids == [1]


def whole_similarities(texts):
    """Cosines of unprojected tf-idf vectors, in plain numpy."""
    held = [[w.text(i) for i in range(len(w))] for w in (R.Words(pa.array([t], pa.string())) for t in texts)]
    vocabulary = {x: i for i, x in enumerate(sorted({x for h in held for x in h}))}
    tf = np.zeros((len(texts), len(vocabulary)))
    for k, h in enumerate(held):
        np.add.at(tf[k], [vocabulary[x] for x in h], 1)
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((len(texts) + 1) / ((tf > 0).sum(axis=0) + 1)) + 1e-3)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T
    np.fill_diagonal(sim, -9)
    return sim


def test_recall_against_unprojected_tf_idf(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    topics = [r.sample(vocabulary, 60) for _ in range(150)]
    texts = [" ".join(r.choice(topics[i % 150]) if r.random() < 0.6 else r.choice(vocabulary) for _ in range(80)) for i in range(900)]
    rows, n = R._placed(awkward.frame(spark, [awkward.row(i, t) for i, t in enumerate(texts)]).select("doc_id", "text"))
    number = {x.rid: x.doc_id for x in rows.select("rid", "doc_id").collect()}
    sim = whole_similarities(texts)
    for cell_rows, least in ((R.CELL_ROWS, 0.99), (100, 0.7)):
        hit = 0
        for x in R.graph(rows, n, cell_rows=cell_rows)[0].collect():
            assert list(x.sims) == sorted(x.sims, reverse=True) and len(set(x.others)) == len(x.others) <= R.NEIGHBOURS and x.rid not in x.others
            mine = sim[number[x.rid]]
            hit += (mine[[number[o] for o in x.others]] >= np.sort(mine)[-R.NEIGHBOURS] - 2e-3).sum()
        assert hit >= least * R.NEIGHBOURS * len(texts)


def test_hot_copies_are_spread(spark):
    """A third of all rows are one text: its cells are split, no block is larger than two cells, and every copy is packed."""
    data = [awkward.row(i, awkward.prose(0 if i % 3 == 0 else i, 40)) for i in range(900)]
    rows, n = R._placed(awkward.frame(spark, data).select("doc_id", "text"))
    _, blocks = R.graph(rows, n, cell_rows=50)
    sizes = [x["count"] for x in blocks.groupBy("block").count().collect()]
    assert max(sizes) < 100 and sum(sizes) == 900
    lossless([(x, words(x[1])) for x in data], R.pack(awkward.frame(spark, data), window_words=300, cell_rows=50).collect(), 300)


def test_rare_words_of_many_rows(spark):
    """All rows of a word are paired, of however many rows, and sums over words that lie in different pieces and tasks are whole."""
    rng = np.random.default_rng(5)
    n = 300
    # word 0 is in all rows, others in some
    held = [np.unique(np.append(0, rng.integers(1, 80, 6))) for _ in range(n)]
    value = [rng.random(len(w)).astype(np.float32) for w in held]
    dense = np.zeros((n, 80))
    for i, (w, v) in enumerate(zip(held, value)):
        v /= np.linalg.norm(v)
        dense[i, w] = v
    rare = [np.rec.fromarrays([w, v], dtype=R._RECORD).tobytes() for w, v in zip(held, value)]
    rows = spark.createDataFrame([(i, 5, bytearray(x), [0] * R.ORDERS) for i, x in enumerate(rare)], "rid long, n_words long, rare binary, mh array<long>")
    sim = dense @ dense.T
    want = {(i, j): sim[i, j] for i in range(n) for j in range(n) if i != j and sim[i, j] >= R.RARE_FROM}
    got = {}
    for x in R.by_rare_words(rows).collect():
        for o, s in zip(x.others, x.sims):
            assert (x.rid, o) not in got
            got[x.rid, o] = s
    edge = {p for p in want.keys() ^ got.keys() if abs(sim[p] - R.RARE_FROM) < 1e-5}
    assert (want.keys() ^ got.keys()) == edge and all(abs(got[p] - sim[p]) < 1e-4 for p in got)
    word, rid = np.repeat(np.arange(80), n), np.tile(np.arange(n), 80)
    pieces = [len(a) for a, _, _ in R.pair_sums(word[: 2 * n], rid[: 2 * n], np.ones(2 * n, np.float32), 1000)]
    assert max(pieces) <= 1000 and sum(pieces) == n * (n - 1)


def test_pieces_of_a_cell_meet(spark, monkeypatch):
    """A cell cut into pieces, by a hot MinHash or as it is too large for a task, gives each row the nearest of the whole cell, with and without many copies in it."""
    monkeypatch.setattr(R, "CLUSTERS", 1)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(700)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(500)]
    for data, hot in ((texts, True), (texts, False), (texts[:200] + texts[:1] * 150, True)):
        rows, n = R._placed(awkward.frame(spark, [awkward.row(i, t) for i, t in enumerate(data)]).select("doc_id", "text"))
        # one MinHash for all, or different ones that lie in the first of the cluster's cells
        number = {x.rid: x.doc_id for x in rows.select("rid", "doc_id").collect()}
        rows = rows.withColumn("mh", R.F.array_repeat(R.F.lit(1).cast("bigint") if hot else R.F.col("rid") % 1000, R.ORDERS))
        found = R.in_cells(rows, n, 5, 60).cache()
        both = found.select("rid", "others", "sims").unionByName(R.in_pieces(found, 5, 60))
        best = both.repartition(3, "rid").sortWithinPartitions("rid").mapInArrow(R._best(5), R._NEAR).collect()
        assert len({x.block for x in found.select("block").collect() if x.block is not None}) > 3 and len(best) == len(data)
        sim = whole_similarities(data)
        for x in best:
            mine = sim[number[x.rid]]
            assert len(x.others) == 5 and x.rid not in x.others
            assert (mine[[number[o] for o in x.others]] >= np.sort(mine)[-5:].min() - 1e-2).all()


def test_nearest_apart():
    """Pairs of two sets alone, against a dense product."""
    rng = np.random.default_rng(8)
    dense = ((rng.random((1500, 300)) < 0.06) * rng.random((1500, 300))).astype(np.float32)
    row, word = np.nonzero(dense)
    for apart in (1, 700, 1499):
        r, o, s = R.nearest(np.searchsorted(row, np.arange(1501)), word.astype(np.uint32), dense[row, word], 5, apart)
        sim = dense @ dense.T
        sim[:apart, :apart] = sim[apart:, apart:] = -1
        want = np.sort(sim, axis=1)[:, -5:]
        assert ((r < apart) != (o < apart)).all() and np.allclose(sim[r, o], s, atol=1e-5)
        assert np.allclose(np.sort(s), np.sort(want[want > 0]), atol=1e-5)


def test_shuffles_of_a_write_are_freed(spark, monkeypatch):
    """The cleanup holds for the write alone, also if it fails."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, seen = spark.conf.get(key), []
    real = R.common.written
    monkeypatch.setattr(R.common, "written", lambda *a: (seen.append(spark.conf.get(key)), real(*a))[1])
    assert sorted(x.id for x in R._freed(spark.range(50).repartition(3, "id"), "freed").collect()) == list(range(50))
    monkeypatch.setattr(R.common, "written", lambda *a: 1 / 0)
    try:
        R._freed(spark.range(1), "freed")
    except ZeroDivisionError:
        seen.append("failed")
    assert seen == ["true", "failed"] and spark.conf.get(key) == was


def test_vectors_of_cut_cells_are_written_once(spark, monkeypatch):
    """However many pieces a cell has, each vector lies in one file for all of them and isn't sent again; the files are gone when the graph is there."""
    monkeypatch.setattr(R, "CLUSTERS", 1)
    rows, n = R._placed(awkward.frame(spark, [awkward.row(i, awkward.prose(i, 40)) for i in range(400)]).select("doc_id", "text"))
    rows = rows.withColumn("mh", R.F.array_repeat(R.F.lit(1).cast("bigint"), R.ORDERS)).cache()
    found = R.in_cells(rows, n, 5, 20, [1], folder=R.common.scratch_path(spark, "packing-pieces")).cache()
    assert "vector" not in found.columns and found.where("block IS NOT NULL").isEmpty()
    pieces = [x.piece for x in found.where("piece IS NOT NULL").collect()]
    held = {x["rid"]: x["vector"] for p in pieces for x in R._got(p).to_pylist()}
    assert len(pieces) > 15 and sum(R._got(p).num_rows for p in pieces) == len(held) == 400
    assert held == {x.rid: bytes(x.vector) for x in rows.collect()}
    folders = []
    real = R.common.scratch_path
    monkeypatch.setattr(R.common, "scratch_path", lambda s, name: (path := real(s, name), folders.append(path) if name == "packing-pieces" else None)[0])
    assert R.graph(rows, n, cell_rows=20)[0].count() == 400
    left = [R.pafs.FileSystem.from_uri(x) for x in folders]
    assert len(left) == R.ORDERS and all(system.get_file_info(inner).type == R.pafs.FileType.NotFound for system, inner in left)


def test_sums_of_pickled_values_are_fast(monkeypatch):
    """Values that went to a worker have a dtype object of their own; numpy adds them up by its fast loop only if all have the one it holds."""
    seen = []
    watched = types.SimpleNamespace(at=lambda flat, at, x: (seen.append((flat.dtype is np.dtype(np.float32), at.dtype is np.dtype(np.intp), x.dtype is np.dtype(np.float32))), np.add.at(flat, at, x)), reduceat=np.add.reduceat)
    rng = np.random.default_rng(9)
    word = np.concatenate([np.sort(rng.choice(3000, 40, replace=False)) for _ in range(600)]).astype(np.uint32)
    first, value = np.arange(0, len(word) + 1, 40), rng.random(len(word)).astype(np.float32)
    sent = pickle.loads(pickle.dumps(value))
    assert sent.dtype is not np.dtype(np.float32)
    want = R.nearest(first, word, value, 5)
    monkeypatch.setattr(R, "np", types.SimpleNamespace(**{**vars(np), "add": watched}))
    got = R.nearest(first, word, sent, 5)
    assert seen and all(all(x) for x in seen) and all((a == b).all() for a, b in zip(want, got))

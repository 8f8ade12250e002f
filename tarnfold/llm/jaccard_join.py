"""N-gram Jaccard self-join by chosen paths.

1. A scan reduces each document to a MinHash of its word n-grams; documents with the same grams become one class.
2. Every run walks each class down a tree of its own: at a node two positions of the MinHash are chosen, by a seed of the
   node, and the node's sets go to one child for each position's value. The first level is a shuffle by (run, position, value). A node that is too
   big for one task is split again by a further shuffle; smaller ones go on inside their task: up to leaf sets are compared
   by brute force; of more, those that resemble the whole node (on average (1 - slack) of the threshold) are compared with all of it and leave, and the rest is split again.
   Nodes that no split makes smaller are compared in pairs of blocks.
3. Runs come in batches. From the pairs found once and twice the number of missed ones is estimated, and the same for classes by the best pair of
   each; batches are added until both meet the target recall, however many it takes, as every run finds some of what is missed.
   Where only connected groups are wanted (keep_one), runs of their own come first: in large nodes, sets that resemble a pivot are linked to it, and these links are verified. Pairs within a
   group that is connected thereby are not looked for: they could change no group, and there are as many as the square of its size. All pairs across groups are.
4. Candidates are pairs whose MinHashes agree in at least as many positions as the threshold asks less three standard deviations (20 of 64 at 0.5; a pair that lies
   exactly at the threshold falls below with a chance of 0.1 %, one at 0.55 of 0.003 %). Their gram sets are read in a second scan, cut into the same partitions (common.pin_scans),
   each sent once to its group of candidates, and compared exactly: precision is 1.

Texts are never shuffled; gram sets are for the classes in candidate pairs only.

Defined results: words and grams are those of text_kernel; a text of fewer words than n is one gram. Null and empty texts, and texts without words, have no grams and
are in no pair, and neither are rows with a null id. Rows that repeat an id with the same grams are one document; those with other grams are another one under the same id. In keep_one the smallest id of each connected group stays, with all of
its rows; rows without grams or ids stay. Texts are taken whole. Other columns, of any name, are passed on by keep_one and ignored otherwise. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .text_kernel import WORD_SQL, Words, mix64, signatures, slices

NGRAM = 3
THRESHOLD = 0.5
POSITIONS = 64
LEAF = 48
SLACK = 0.1
RUNS = 3
TARGET_RECALL = 0.98
NODE_LIMIT = 50_000
BLOCK = 1_000
PIECE = 1 << 18
PIECE_BYTES = 1 << 24
STAR_RUN = 1 << 20
SPLITS = 5
SEED = 20240711
_U = np.uint64


def _key(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(1, _U)
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix64((h + _U(0x9E3779B97F4A7C15)) ^ np.asarray(p).astype(_U))
    return h


def _positions(node: np.ndarray, which: int) -> np.ndarray:
    """The first or second position that is chosen at each node; the two differ."""
    one = (_key(node, np.array([SEED])) % _U(POSITIONS)).astype(np.int64)
    if not which:
        return one
    return (one + 1 + (_key(node, np.array([SEED + 1])) % _U(POSITIONS - 1)).astype(np.int64)) % POSITIONS


def _sketch(ngram: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        for piece in slices(batches, "text"):
            ids = piece.column("doc_id")
            w = Words(piece.column("text"))
            grams, first = w.grams(ngram)
            some = np.flatnonzero(np.diff(first) > 0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)[some]
            have = some[named]
            if not len(have):
                continue
            distinct, at = _sets(grams, first)
            prints = [_prints(distinct, at[some], s)[named] for s in (0x51ED270B, 0xA0761D64)]
            sig = signatures(grams, first, POSITIONS, SEED)[have]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(have)),
                    pa.array(np.full(len(have), part, np.int32)),
                    pa.array(prints[0].view(np.int64)),
                    pa.array(prints[1].view(np.int64)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * POSITIONS), len(have), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                ],
                names=["doc_id", "part", "cid", "check", "sig"],
            )

    return run


def _prints(distinct: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """Order-free hash of each set; starts are those of all sets that aren't empty."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix64(distinct ^ _U(salt)), starts) if len(starts) else np.zeros(0, _U)


def _sets(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct grams, ascending, and where its own begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    o = np.lexsort((grams, doc))
    g, d = grams[o], doc[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], np.searchsorted(d[new], np.arange(len(first)))


def _classes(docs: DataFrame, ngram: int) -> tuple[DataFrame, DataFrame]:
    """(one row for each distinct id and gram set: cid, doc_id, part; one for each gram set: cid, its smallest member, the number of members, the MinHash, a group of its own).

    Members are rows and never lists, so that a class may hold any share of the documents; classes are aggregated before they are shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = common.written(docs.mapInArrow(_sketch(ngram), f"doc_id {kind}, part int, cid bigint, check bigint, sig binary"), "jaccard-sketch")
    members = rows.select("cid", "doc_id", "part").distinct()
    counted = members.groupBy("cid").agg(F.count_distinct("doc_id").alias("n"))
    grouped = rows.groupBy("cid", "check").agg(F.min(F.struct("doc_id", "part")).alias("first"), F.min("sig").alias("sig"))
    return members, common.written(grouped.drop("check").join(counted, "cid").withColumn("group", F.col("cid")), "jaccard-classes")


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), kind)
    flat = column.cast(pa.binary(width * np.dtype(kind).itemsize))
    return np.frombuffer(flat.buffers()[1], kind, len(column) * width, flat.offset * width * np.dtype(kind).itemsize).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _first_level(runs: range):
    def run(batches):
        for b in batches:
            sig = _matrix(b.column("sig"), np.uint32, POSITIONS)
            low = sig.astype(np.uint8)
            for r in runs:
                root = _key(np.array([SEED + 2]), np.array([r]))
                chosen = [_positions(root, k)[0] for k in (0, 1)]
                for c in chosen:
                    node = _key(root, np.array([c]), sig[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), r, np.int32)), pa.array(node.view(np.int64)), b.column("cid"), b.column("group"), _binary(low)], names=["run", "node", "cid", "group", "sig"])

    return run


def _next_level(batches):
    for b in batches:
        sig = _matrix(b.column("sig"), np.uint8, POSITIONS)
        node = b.column("node").to_numpy().view(_U)
        for k in (0, 1):
            c = _positions(node, k)
            child = _key(node, c, sig[np.arange(len(sig)), c])
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(child.view(np.int64)), b.column("cid"), b.column("group"), b.column("sig")], names=["run", "node", "cid", "group", "sig"])


_LEVEL = "run int, node bigint, cid bigint, group bigint, sig binary"


def _nodes(classes: DataFrame, runs: range, node_limit: int) -> DataFrame:
    """Rows (run, node, cid, group, sig) such that each node fits into one task."""
    level = classes.select("cid", "group", "sig").mapInArrow(_first_level(runs), _LEVEL)
    done = []
    for depth in range(SPLITS + 1):
        big = level.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > node_limit)
        big = common.written(big, "jaccard-big-nodes")
        if big.isEmpty():
            break
        done.append(level.join(big, "node", "left_anti").select("run", "node", "cid", "group", "sig"))
        inside = level.join(big, "node")
        if depth < SPLITS:
            level = common.written(inside.select("run", "node", "cid", "group", "sig").mapInArrow(_next_level, _LEVEL).distinct(), "jaccard-level")
            continue
        # what no choice of positions has made smaller: pairs of blocks, each of which fits
        blocks = F.ceil(2 * F.col("n") / node_limit).cast("int")
        own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        level = inside.select("run", "node", "cid", "group", "sig", own.alias("own"), other.alias("other"))
        pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
        level = level.select("run", pair.alias("node"), "cid", "group", "sig").distinct()
    for x in done:
        level = level.unionByName(x)
    return level


def _agree(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 16):
        out[a : a + (1 << 16)] = (sig[i[a : a + (1 << 16)]] == sig[j[a : a + (1 << 16)]]).sum(axis=1)
    return out


def _resemblance(values: np.ndarray) -> np.ndarray:
    """In what share of positions each row agrees with the others, on average."""
    mean = np.zeros(len(values))
    for c in range(POSITIONS):
        mean += np.bincount(values[:, c], minlength=256)[values[:, c]] - 1
    return mean / (POSITIONS * max(len(values) - 1, 1))


def node_pairs(node: np.ndarray, sig: np.ndarray, least: int, threshold: float, leaf: int = LEAF, slack: float = SLACK, group: np.ndarray | None = None):
    """Pieces (i, j) of what compare_nodes finds, each of about PIECE pairs at most, so that memory doesn't grow with the pairs of a node; a pair may be in several pieces."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def pieces(most: int):
        if sum(len(i) for i, _ in found) > most:
            i, j = np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])
            found.clear()
            low, high = np.minimum(i, j), np.maximum(i, j)
            key = np.unique((low * len(sig) + high)[low != high])
            for x in range(0, len(key), PIECE):
                yield key[x : x + PIECE] // len(sig), key[x : x + PIECE] % len(sig)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        if group is not None:
            apart = group[i] != group[j]
            i, j = i[apart], j[apart]
        ok = _agree(sig, i, j) >= least
        if ok.any():
            found.append((i[ok], j[ok]))

    rows = np.arange(len(node))
    depth = 0
    while len(rows):
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(start, len(node)))
        small = np.repeat(size <= leaf, size)
        if small.any():
            n, r = node[small], rows[small]
            for d in range(1, int(size[size <= leaf].max())):
                at = np.flatnonzero(n[d:] == n[:-d])
                if not len(at):
                    break
                keep(r[at], r[at + d])
                yield from pieces(PIECE)
        left_rows, left_node = [], []
        for s, m in zip(start[size > leaf].tolist(), size[size > leaf].tolist()):
            own = rows[s : s + m]
            of = None if group is None else group[own]
            if of is not None and (of == of[0]).all():
                continue
            values = sig[own]
            central = (_resemblance(values) >= (1 - slack) * threshold) | (depth >= 24)
            for k in np.flatnonzero(central).tolist():
                # a central row against the others; of two central ones, the later looks
                rest = ~central | (np.arange(m) < k)
                rest = np.flatnonzero(rest if of is None else rest & (of != of[k]))
                hit = rest[(values[rest] == values[k]).sum(axis=1) >= least]
                if len(hit):
                    found.append((np.full(len(hit), own[k]), own[hit]))
                    yield from pieces(PIECE)
            if not central.all():
                left_rows.append(own[~central])
                left_node.append(np.full(int((~central).sum()), node[s]))
        if not left_rows:
            break
        r, n = np.concatenate(left_rows), np.concatenate(left_node)
        children = []
        for k in (0, 1):
            c = _positions(n, k)
            children.append(_key(n, c, sig[r, c]))
        rows, node = np.concatenate([r, r]), np.concatenate(children)
        o = np.argsort(node, kind="stable")
        rows, node = rows[o], node[o]
        depth += 1
    yield from pieces(0)


def compare_nodes(node: np.ndarray, sig: np.ndarray, least: int, threshold: float, leaf: int = LEAF, slack: float = SLACK, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of rows of one node, found by going down its tree, that agree in at least `least` positions and are of different groups, if these are given.

    node is sorted; only rows of equal node are compared.
    """
    found = list(node_pairs(node, sig, least, threshold, leaf, slack, group))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.column_stack([np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def star_pairs(node: np.ndarray, sig: np.ndarray, least: int, threshold: float, leaf: int = LEAF, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (pivot, other) in nodes of more than leaf rows: rows that resemble the whole node are pivots in turn, and those that agree with one leave with it. Fewer pairs than rows."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(start, len(node)))
    for s, m in zip(start[size > leaf].tolist(), size[size > leaf].tolist()):
        values = sig[s : s + m]
        central = _resemblance(values) >= (1 - slack) * threshold
        left = np.ones(m, bool)
        while (left & central).any():
            k = int(np.argmax(left & central))
            left[k] = False
            rest = np.flatnonzero(left)
            hit = rest[(values[rest] == values[k]).sum(axis=1) >= least]
            left[hit] = False
            found.append((np.full(len(hit), s + k), s + hit))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _compare(threshold: float, least: int, stars: bool = False):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            node = table.column("node").to_numpy()
            run_, cid, group = (table.column(x).to_numpy() for x in ("run", "cid", "group"))
            again = np.append(False, node[1:] == node[:-1])
            shared = again | np.append(again[1:], False)
            if not shared.any():
                return
            sig = _matrix(table.column("sig").filter(pa.array(shared)), np.uint8, POSITIONS)
            node, run_, cid, group = node[shared], run_[shared], cid[shared], group[shared]
            for i, j in [star_pairs(node.view(_U), sig, least, threshold)] if stars else node_pairs(node.view(_U), sig, least, threshold, group=group):
                a, b = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
                pairs = np.unique(np.column_stack([a, b, run_[i], _agree(sig, i, j)])[a != b], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32)), pa.array(pairs[:, 3].astype(np.int32))], names=["a", "b", "run", "agree"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            nodes = b.column("node")
            last = nodes[b.num_rows - 1]
            if sum(x.num_rows for x in held) < 50_000 or nodes[0] == last:
                continue
            # the last node may go on in the next batch
            cut = int(np.searchsorted(nodes.to_numpy(), last.as_py()))
            yield from done(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _missed(counts, total: int) -> float:
    """How many were never found in total runs, by those that were found once and twice."""
    return (total - 1) / total * counts["once"] * max(counts["once"] - 1, 0) / (2 * (counts["twice"] + 1))


def _compared(classes: DataFrame, runs: range, node_limit: int, threshold: float, least: int, stars: bool = False) -> DataFrame:
    sorted_ = _nodes(classes, runs, node_limit).repartition(max(1, common.shuffle_width(classes.sparkSession)), "node").sortWithinPartitions("node")
    return sorted_.mapInArrow(_compare(threshold, max(1, least), stars), "a bigint, b bigint, run int, agree int")


def _candidates(classes: DataFrame, threshold: float, target_recall: float, runs: int, node_limit: int) -> DataFrame:
    """Distinct pairs (a, b) of class ids of different groups, a < b; written."""
    least = int(np.floor(POSITIONS * (threshold - 3 * np.sqrt(threshold * (1 - threshold) / POSITIONS))))
    batches: list[DataFrame] = []
    tally = [F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")]
    while True:
        k = len(batches)
        batches.append(common.written(_compared(classes, range(k * runs, (k + 1) * runs), node_limit, threshold, least), "jaccard-pairs"))
        union = batches[0]
        for x in batches[1:]:
            union = union.unionByName(x)
        found = common.written(union.groupBy("a", "b").agg(F.count_distinct("run").alias("n"), F.max("agree").alias("agree")), "jaccard-candidates")
        # recall is promised for pairs over the threshold; those below, which are found less often, don't count
        near = found.where(F.col("agree") >= POSITIONS * threshold)
        # and for classes, by the best pair of each, so that the many pairs of a large group don't speak for small ones
        best = near.select(F.explode(F.array("a", "b")).alias("cid"), "n", "agree").groupBy("cid").agg(F.max(F.struct("agree", "n"))["n"].alias("n"))
        total = runs * (k + 1)
        if all(c["all"] >= target_recall * (c["all"] + _missed(c, total)) for c in (near.agg(*tally).first(), best.agg(*tally).first())):
            return found.select("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest id that is connected with each node, by alternating large and small stars."""
    now = common.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = F.min("v").over(w)
        small = large.withColumn("m", m)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = common.written(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the candidates that meet the threshold, compared by their whole gram sets; written.

    A group of candidates is cut into blocks of about BLOCK sets, and each pair of blocks is a unit of work (key) of its own.
    """
    spark = docs.sparkSession
    width = max(1, common.shuffle_width(spark))
    roots = components(candidates)
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = roots.join(sizes, "root").select("node", "root", "blocks")
    block_of = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    pair = F.xxhash64("root", F.least(block_of("a"), block_of("b")), F.greatest(block_of("a"), block_of("b")))
    keyed = common.written(candidates.join(placed, F.col("a") == F.col("node")).select("a", "b", pair.alias("key")), "jaccard-keyed")
    wanted = keyed.select("key", F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.collect_set("key").alias("keys"))
    lists = wanted.join(classes.select("cid", F.col("first")["part"].alias("part"), F.col("first")["doc_id"].alias("doc_id")), "cid")
    where = common.written_by_part(lists, "jaccard-wanted")
    listed = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("cid", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sets_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "a", "grams"])

    def read(batches):
        known = None
        for piece in slices(batches, "text"):
            if known is None:
                table = common.read_part(where, TaskContext.get().partitionId(), listed)
                known = {}
                for d, c, k in zip(*(table.column(x).to_pylist() for x in ("doc_id", "cid", "keys"))):
                    known.setdefault(d, []).append((c, k))
            if not known:
                continue
            ids = piece.column("doc_id").to_pylist()
            mine = [i for i, d in enumerate(ids) if d in known]
            if not mine:
                continue
            grams, first = Words(piece.column("text").take(pa.array(mine))).grams(ngram)
            distinct, at = _sets(grams, first)
            some = np.flatnonzero(np.diff(at) > 0)
            prints = dict(zip(some.tolist(), _prints(distinct, at[some], 0x51ED270B).view(np.int64).tolist()))
            rows, size = [], 0
            for k, i in enumerate(mine):
                for c, keys in known[ids[i]]:
                    # rows that share an id may differ in text
                    if prints.get(k) != c:
                        continue
                    own = distinct[at[k] : at[k + 1]].tobytes()
                    for key in keys:
                        rows.append((key, c, own))
                        size += len(own)
                        if size > PIECE_BYTES:
                            yield sets_of(rows)
                            rows, size = [], 0
            if rows:
                yield sets_of(rows)

    def compare(batches):
        key, held = None, {}
        for t in batches:
            out = []
            for k, a, b, g in zip(t.column("key").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("grams")):
                if k != key:
                    key, held = k, {}
                if g.is_valid:
                    held[a] = np.frombuffer(g.as_py(), _U)
                    continue
                x, y = held[a], held[b]
                both = _shared(x, y)
                j = both / (len(x) + len(y) - both)
                if j >= threshold:
                    out.append((a, b, j))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["a", "b", "jaccard"])

    sets = docs.mapInArrow(read, "key bigint, a bigint, grams binary").select("key", "a", F.lit(None).cast("bigint").alias("b"), "grams")
    work = sets.unionByName(keyed.select("key", "a", "b", F.lit(None).cast("binary").alias("grams")))
    # a key's sets come before its pairs; at any time a task holds the sets of one key, at most about two blocks
    stream = work.repartition(width, "key").sortWithinPartitions("key", F.col("b").asc_nulls_first())
    return common.written(stream.mapInArrow(compare, "a bigint, b bigint, jaccard double"), "jaccard-verified")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """The number of common values of two ascending arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _in_groups(docs: DataFrame, classes: DataFrame, ngram: int, threshold: float, runs: int, node_limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(classes with groups that verified links connect, these links if there are any)."""
    found = _compared(classes, range(STAR_RUN, STAR_RUN + runs), node_limit, threshold, int(np.ceil(POSITIONS * threshold)), stars=True)
    stars = common.written(found.select("a", "b").distinct(), "jaccard-stars")
    if stars.isEmpty():
        return classes, None
    links = _verified(docs, classes, stars, ngram, threshold)
    placed = classes.drop("group").join(components(links).select(F.col("node").alias("cid"), F.col("root").alias("group")), "cid", "left")
    return common.written(placed.withColumn("group", F.coalesce("group", "cid")), "jaccard-grouped"), links


def _join(docs, id_col, text_col, ngram, threshold, target_recall, runs, node_limit, groups_only=False):
    """(members, classes, verified pairs of classes); if only connected groups are wanted, enough pairs to connect them."""
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    common.pin_scans(docs.sparkSession)
    if not common.is_plain_scan(narrow):
        narrow = common.written(narrow, "jaccard-input")
    members, classes = _classes(narrow, ngram)
    links = None
    if groups_only:
        classes, links = _in_groups(narrow, classes, ngram, threshold, runs, node_limit)
    pairs = _verified(narrow, classes, _candidates(classes, threshold, target_recall, runs, node_limit), ngram, threshold)
    return members, classes, links.unionByName(pairs) if links else pairs


def _grouped(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, n, class_id) of every class: class_id is the smallest id of the connected group."""
    roots = components(pairs)
    placed = classes.select("cid", "n", F.col("first")["doc_id"].alias("smallest")).join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.where("node IS NOT NULL").groupBy("root").agg(F.min("smallest").alias("least"))
    return placed.join(least, "root", "left").select("cid", "n", F.coalesce("least", "smallest").alias("class_id"))


def linked_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    runs: int = RUNS,
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links): one row for each document that is similar to another one.

    class_id is the smallest id of its connected group; n_copies counts the other documents with the same gram set, n_links those with a different
    gram set of at least the threshold's Jaccard index.
    """
    members, classes, pairs = _join(docs, id_col, text_col, ngram, threshold, target_recall, runs, node_limit)
    both = pairs.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    sizes = classes.select(F.col("cid").alias("other"), F.col("n").alias("of_other"))
    links = both.join(sizes, "other").groupBy("cid").agg(F.sum("of_other").alias("n_links"))
    told = _grouped(classes, pairs).join(links, "cid", "left").where("n > 1 OR n_links IS NOT NULL")
    told = told.select("cid", "class_id", (F.col("n") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    return members.select("cid", "doc_id").distinct().join(told, "cid").select("doc_id", "class_id", "n_copies", "n_links")


def similar_pairs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    runs: int = RUNS,
    node_limit: int = NODE_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """((doc_id, other_id, jaccard): pairs of representatives; (doc_id, representative): all documents).

    Documents with the same gram set are represented by the one with the smallest id. Two documents have at least the threshold's Jaccard index
    if they have the same representative or their representatives are a pair; no such link is left out.
    """
    members, classes, pairs = _join(docs, id_col, text_col, ngram, threshold, target_recall, runs, node_limit)
    ids = classes.select("cid", F.col("first")["doc_id"].alias("id"))
    both = pairs.join(ids.toDF("a", "one"), "a").join(ids.toDF("b", "two"), "b")
    across = both.select(F.least("one", "two").alias("doc_id"), F.greatest("one", "two").alias("other_id"), "jaccard")
    return across, members.select("cid", "doc_id").distinct().join(ids, "cid").select("doc_id", F.col("id").alias("representative"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    runs: int = RUNS,
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """docs with one document of each connected group of similar ones: that with the smallest id."""
    spark, names = docs.sparkSession, docs.columns
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    common.pin_scans(spark)
    if not common.is_plain_scan(docs):
        docs = common.written(docs, "jaccard-input")
    members, classes, pairs = _join(docs, id_col, text_col, ngram, threshold, target_recall, runs, node_limit, groups_only=True)
    losers = members.join(_grouped(classes, pairs).select("cid", "class_id"), "cid").where("doc_id <> class_id").select("doc_id", "part").distinct()
    where = common.written_by_part(losers, "jaccard-losers")
    at = docs.columns.index(id_col)

    def keep(batches):
        gone = None
        for b in batches:
            if gone is None:
                gone = common.read_part(where, TaskContext.get().partitionId(), pa.schema([("doc_id", b.schema.field(at).type)])).column(0).combine_chunks()
            yield b.filter(pc.invert(pc.is_in(b.column(at), value_set=gone, skip_nulls=True)))

    return docs.mapInArrow(keep, docs.schema).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document of the table that is similar to another one, with its group and the number of its links."""
    return linked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')"

#: Counts shared grams of all pairs and walks groups recursively: meant for the sizes of tests.
ORACLE_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '{WORD_SQL}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {NGRAM} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {NGRAM - 1}], ' ') END AS gram
  FROM worded, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - {NGRAM - 2}))) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b, s.n = x.n AND s.n = y.n AS same FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s.n >= {THRESHOLD} * (x.n + y.n - s.n)
), reached AS (
  SELECT DISTINCT a AS doc_id, a AS seen FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.seen
), smallest AS (SELECT doc_id, min(seen) AS class_id FROM reached GROUP BY doc_id)
SELECT l.a AS doc_id, any_value(class_id) AS class_id, count(*) FILTER (same) AS n_copies, count(*) FILTER (NOT same) AS n_links
FROM links l JOIN smallest s ON s.doc_id = l.a GROUP BY l.a
"""

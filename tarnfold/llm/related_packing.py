"""Packing of related documents: nearest-neighbour graph, greedy paths, windows along them.

1. Counts: in how many documents each of 2^BUCKET_BITS hashed words occurs, over all documents.
2. Vectors: a document is its words with weights (1 + log tf) * idf, of unit length; words that no other document has are left out afterwards. No projection.
3. Graph, from two searches whose results are merged, the `k` best of each document kept:
   a. ORDERS times, documents are put into cells of about `cell_rows`, and in a cell all pairs are compared by the cosine of their whole vectors (values to within 2 %). A cell is one of at most CLUSTERS spherical k-means clusters,
      or, where these are larger than a cell, a part of one by a weighted MinHash of the words. Both differ each time. A cell too large for a task is cut into pieces, and all its pieces are compared with each other.
   b. Each document's RARE rarest shared words bring it together with all that have the same ones among theirs, however many these are; all sums are taken before any neighbour is left out. The nearness
      of such a pair is the cosine over these words alone, and it counts from RARE_FROM on, which takes three words of twelve: fewer say little about the rest.
   This is a search and no exact answer beyond one cell: the README gives its recall against brute force over the whole tf-idf vectors.
4. Paths: within a cell of the first order, a path starts at the unvisited document of the lowest degree, and goes on to the nearest unvisited neighbour until there is none. Then paths are
   joined across cells: the end of a path goes on to the nearest document in its list, or in whose list it is, that begins another path of a higher degree, as long as any such pair is left.
5. Windows: the joined paths that begin in a cell, one after another, are cut into windows of window_words; a document that crosses an end
   is continued in the next window, so that nothing is lost or repeated.

Texts are read twice and never shuffled. What is shuffled is 4 bytes a distinct shared word for each order, 20 bytes a rare word, 12 a pair that shares one, the neighbours found, and a few numbers a document. Cells have
about cell_rows documents; of a MinHash that more than 2 * cell_rows documents and a ten-thousandth of all have, cells are split by row, so that hot groups are spread.
A task holds at most 2 * cell_rows documents or CELL_WORDS words of a cell. What is more lies in further pieces, whose vectors are written once to files in the shared folder; every two pieces of a cell meet in a task that reads these
(quadratic in the documents of one cell, but for copies: of one vector k + 1 documents a piece go there, which fill any list). Orders follow each other, and an order's shuffle and files are deleted before the next. The clusters are fitted to about SAMPLE vectors; there are as many as cells, up to CLUSTERS.

Defined results: null texts, empty texts and texts without words have no vector and no neighbours; they take up no words, and come last in
cells of their own kind (negative) as pieces of 0 words. Ties in degree and along a path go to the smaller id, ties at the k-th place of a list to any of them. Rows that repeat are packed as often as they
occur; null ids are packed as null. Other columns are ignored. An empty table gives no windows. Texts are taken whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .text_kernel import Words, mix64, release, slices

WINDOW_WORDS = 4096
NEIGHBOURS = 5
BUCKET_BITS = 21
WORD_BITS = 24
ORDERS = 2
CELL_ROWS = 6144
CELL_WORDS = 3_000_000
CLUSTERS = 64
FEATURES = 1024
SAMPLE = 8192
RARE = 12
RARE_FROM = 0.24
CHUNK = 50_000
LISTED = 64
PANEL = 512
PIECE = 1 << 20
HEAD_PART = 32
STEP = 1 << 16
SPLIT_BITS = 20
SPLITS = (1 << SPLIT_BITS) - 1
SEED = 20240803
_U = np.uint64


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the distinct buckets of each document."""
    key = (w.docs.astype(np.int64) << BUCKET_BITS) | (w.hash >> _U(64 - BUCKET_BITS)).astype(np.int64)
    uniq, count = np.unique(key, return_counts=True)
    return uniq >> BUCKET_BITS, uniq & ((1 << BUCKET_BITS) - 1), count


def _count(batches):
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    rows = 0
    for piece in slices(batches, "text"):
        w = Words(piece.column("text"))
        rows += int((w.counts > 0).sum())
        if len(w):
            total += np.bincount(_buckets(w)[1], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])


def weights(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(idf of each bucket, from all documents, and at the end that of a word of a single document; the number of documents with words)."""
    found = docs.select("text").mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    df = np.zeros((1 << BUCKET_BITS) + 1)
    df[-1] = 1
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    total = int(n[bucket < 0].sum())
    return np.log((total + 1) / (df + 1)).astype(np.float32), total


#: an entry of a vector: WORD_BITS of the word's hash, and 8 bits of its value on a logarithmic scale from 2^-12 to 1
_ENTRY = np.dtype("<u4")
_SCALE = np.exp2((np.arange(256) - 255) * (12 / 255)).astype(np.float32)
_RECORD = np.dtype([("word", "<i8"), ("value", "<f4")])


def sparse_of(w: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, value, weight) of the words that other documents may share, by document and word; values are of unit length with those of the other words.

    A word is the first 44 bits of its hash.
    """
    n = len(w.counts)
    key = np.sort((w.docs.astype(_U) << _U(44)) | (w.hash >> _U(20)))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    count, key = np.diff(np.append(at, len(key))), key[at]
    doc, word = (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1)
    weight = idf[(word >> _U(44 - BUCKET_BITS)).astype(np.int64)]
    value = (1 + np.log(count)) * (weight + 1e-3)
    value /= np.sqrt(np.bincount(doc, value**2, minlength=n))[doc]
    shared = weight < idf[-1] - 1e-6
    return doc[shared], word[shared], value[shared].astype(np.float32), weight[shared]


def packed(word: np.ndarray, value: np.ndarray) -> np.ndarray:
    q = np.clip(np.rint(np.log2(np.maximum(value, 1e-9)) * (255 / 12) + 255), 0, 255).astype(np.uint32)
    return ((word >> _U(44 - WORD_BITS)).astype(np.uint32) << np.uint32(8)) | q


def _binary(records: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary value for each first[d]:first[d + 1] of the records."""
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * records.itemsize).astype(np.int64)), pa.py_buffer(records.tobytes())]).cast(pa.binary())


def _records(column, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    lists = column.to_pylist()
    return np.frombuffer(b"".join(lists), kind), np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in lists])]).astype(np.int64)


def rarest_of(word: np.ndarray, value: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """(records, first): the words of the greatest idf of each document, their values scaled to unit length."""
    low = (65535 * (1 - weight / max(float(weight.max(initial=0)), 1e-9))).astype(_U)
    o = np.argsort((doc.astype(_U) << _U(40)) | (low << _U(24)) | (word & _U((1 << 24) - 1)))
    doc = doc[o]
    o = o[np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc] < rare]
    out = np.empty(len(o), _RECORD)
    out["word"] = word[o].view(np.int64)
    doc = np.sort(np.repeat(np.arange(n), np.minimum(np.bincount(doc, minlength=n), rare)))
    out["value"] = value[o] / np.sqrt(np.maximum(np.bincount(doc, value[o] ** 2, minlength=n), 1e-20))[doc]
    return out, np.searchsorted(doc, np.arange(n + 1))


def minhash_of(word: np.ndarray, value: np.ndarray, doc: np.ndarray, n: int, order: int) -> np.ndarray:
    """For each document a hash of the word that it draws by the squares of its values: documents of weighted Jaccard index j draw the same with a chance of about j."""
    out = np.zeros(n, _U)
    if len(doc):
        h = mix64(word + _U(((order + 1) * 0x9E3779B97F4A7C15) % (1 << 64)))
        clock = -np.log(((h >> _U(11)).astype(np.float32) + 0.5) / (1 << 53)) / np.maximum(value**2, 1e-12)
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        hit = np.flatnonzero(clock == np.repeat(np.minimum.reduceat(clock, start), np.diff(np.append(start, len(doc)))))[::-1]
        out[doc[hit]] = mix64(h[hit])
    return out


def _embed(held):
    def run(batches):
        idf = held.value
        for piece in slices(batches, "text"):
            w = Words(piece.column("text"))
            n = len(w.counts)
            doc, word, value, weight = sparse_of(w, idf)
            entries = packed(word, value)
            rare, first = rarest_of(word, value, weight, doc, n, RARE)
            hashes = [minhash_of(word, value, doc, n, r) for r in range(ORDERS)]
            mh = pa.ListArray.from_arrays(np.arange(0, ORDERS * n + 1, ORDERS, dtype=np.int32), pa.array(np.stack(hashes, axis=1).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(w.counts.astype(np.int64)), _binary(entries, np.searchsorted(doc, np.arange(n + 1))), _binary(rare, first), mh], names=["doc_id", "n_words", "vector", "rare", "mh"]
            )

    return run


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """((rid, doc_id, n_words, vector, rare, mh) of every row, the number of rows with words); rid numbers rows, for good, as the table is written."""
    idf, n = weights(docs)
    held = docs.sparkSession.sparkContext.broadcast(idf)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.mapInArrow(_embed(held), f"doc_id {kind}, n_words bigint, vector binary, rare binary, mh array<bigint>")
    return common.written(rows.withColumn("rid", F.monotonically_increasing_id()), "packing-vectors"), n


def _dense(entries: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Vectors folded into FEATURES hashed words with signs, of unit length."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * FEATURES + (entries >> np.uint32(8)).astype(np.int64) % FEATURES
    sign = np.where(entries >> np.uint32(31), 1.0, -1.0)
    out = np.bincount(at, _SCALE[entries & np.uint32(255)] * sign, minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit_clusters(x: np.ndarray, clusters: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: centres of unit length, begun at rows drawn by a seed."""
    if len(x) <= clusters:
        return x if len(x) else np.zeros((1, FEATURES), np.float32)
    centre = x[np.random.default_rng(seed).choice(len(x), clusters, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        for c in range(clusters):
            if (own == c).any():
                centre[c] = x[own == c].mean(axis=0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def nearest(first: np.ndarray, word: np.ndarray, value: np.ndarray, k: int, apart: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine) of the k nearest others of each row, over all pairs; rows are sparse, word[first[i]:first[i + 1]] with values.

    With apart, only the pairs of a row before it and one from it on. Frequent words go through a matrix product, the others through their lists of rows. Rows that share no word are no neighbours.
    """
    n = len(first) - 1
    # _SCALE reaches workers pickled, and so with a dtype object of its own, for which np.add.at has its slow loop only
    value = value.astype(np.float32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    # by word, and within a word by row
    o = np.argsort((word & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    o = o[np.argsort((word[o] >> np.uint32(16)).astype(np.uint16), kind="stable")]
    new = np.append(True, np.diff(word[o]) != 0)[: len(o)]
    df = np.diff(np.append(np.flatnonzero(new), len(o)))
    word = np.empty(len(o), np.int32)
    word[o] = np.cumsum(new, dtype=np.int32) - 1
    frequent = df > max(PANEL // 8, n // HEAD_PART)
    of_head = frequent[word]
    heads = np.zeros((n, int(frequent.sum())), np.float32)
    heads[doc[of_head], (np.cumsum(frequent) - 1)[word[of_head]]] = value[of_head]
    tail = ~of_head & (df[word] > 1)
    o = o[tail[o]]
    listed, listed_value = doc[o], value[o]
    # where each word's list ends, and where it goes on from the first row that the panel is compared with
    stop = np.cumsum(np.where(frequent | (df < 2), 0, df))
    onward = np.append(0, stop)[: len(stop)]
    onward += np.bincount(word[tail & (doc < apart)], minlength=len(df))
    doc, word, value = doc[tail], word[tail], value[tail]
    del o, new, of_head, tail
    found: list[tuple] = []
    # what the k-th best of each row is at least
    least = np.zeros(n, np.float32)

    def keep(s: np.ndarray, rows: int, others: int) -> None:
        m = s.shape[1]
        few = min(k, m)
        # in pieces, as places take twice the room of the values
        for i in range(0, len(s), step := max(1, PIECE // m)):
            part = s[i : i + step]
            best = np.argpartition(part, m - few, axis=1)[:, m - few :] if few < m else np.tile(np.arange(m), (len(part), 1))
            sim = np.take_along_axis(part, best, 1)
            if few == k:
                at = slice(rows + i, rows + i + len(part))
                least[at] = np.maximum(least[at], sim.min(axis=1))
            sim = sim.ravel()
            ok = sim > 0
            found.append(((np.repeat(np.arange(len(part), dtype=np.int32), few) + np.int32(rows + i))[ok], (best.ravel() + others)[ok].astype(np.int32), sim[ok]))

    for a in range(0, apart or n, PANEL):
        b, left = min(a + PANEL, apart or n), apart or a
        width = n - left
        s = heads[a:b] @ heads[left:].T
        flat = s.reshape(-1)
        lo, hi = np.searchsorted(doc, [a, b])
        begin = onward[word[lo:hi]]
        count = stop[word[lo:hi]] - begin
        base = (doc[lo:hi].astype(np.int64) - a) * width - left
        ends = np.cumsum(count)
        at = 0
        while at < hi - lo:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            c = count[at:to]
            place = np.arange(int(c.sum()))
            place += np.repeat(begin[at:to] - (np.cumsum(c) - c), c)
            target = np.repeat(base[at:to], c)
            target += listed[place]
            product = np.repeat(value[lo + at : lo + to], c)
            product *= listed_value[place]
            np.add.at(flat, target, product)
            at = to
        if not apart:
            onward += np.bincount(word[lo:hi], minlength=len(df))
            s[np.arange(b - a), np.arange(b - a)] = -1
        if width:
            keep(s, a, left)
        for c in range(apart or b, n, step := max(1, PIECE // (b - a))):
            part = s[:, c - left : min(c + step, n) - left]
            floor = least[c : c + part.shape[1]]
            near = part > floor
            # where few are over what is known, these are taken as they are
            if floor.min() > 0 and np.count_nonzero(near) <= 4 * k * len(floor):
                row, col = np.nonzero(near)
                found.append(((col + c).astype(np.int32), (row + a).astype(np.int32), part[row, col]))
            else:
                keep(np.ascontiguousarray(part.T), c, a)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    row, other, sim = (np.concatenate([f[i] for f in found]) for i in range(3))
    ok = sim >= least[row]
    row, other, sim = row[ok], other[ok], sim[ok]
    o = np.lexsort((other, -sim, row))
    row, other, sim = row[o], other[o], sim[o]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best].astype(np.int64), other[best].astype(np.int64), sim[best]


_NEAR = "rid bigint, others array<bigint>, sims array<float>"
_FOUND = f"{_NEAR}, block bigint, whole bigint, piece string"
_near_schema = pa.schema([("rid", pa.int64()), ("others", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))])
_found_schema = pa.schema([*_near_schema, ("block", pa.int64()), ("whole", pa.int64()), ("piece", pa.string())])
_piece_schema = pa.schema([("rid", pa.int64()), ("vector", pa.binary())])


def _lists(rid: np.ndarray, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> list[pa.Array]:
    """A row for each rid with its neighbours, which may be none."""
    offsets = pa.array(np.searchsorted(row, np.arange(len(rid) + 1)).astype(np.int32))
    return [pa.array(rid), pa.ListArray.from_arrays(offsets, pa.array(rid[other])), pa.ListArray.from_arrays(offsets, pa.array(sim.astype(np.float32)))]


def surplus(vector: pa.Array, k: int) -> np.ndarray:
    """Which rows have the vector of k + 1 rows before them: their lists are full of copies, and so are those of the rows that are near to them."""
    code = vector.dictionary_encode().indices.to_numpy()
    o = np.argsort(code, kind="stable")
    out = np.empty(len(code), bool)
    out[o] = np.arange(len(code)) - np.searchsorted(code[o], code[o]) > k
    return out


def _put(part: pa.Table, folder: str) -> str:
    """The rows of a piece in a file of their own, under a name that no other attempt of the task has."""
    system, inner = pafs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    name = f"{uuid.uuid4().hex}.arrow"
    with system.open_output_stream(f"{inner}/{name}") as out, pa.ipc.new_file(out, _piece_schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as file:
        file.write_table(part.select(_piece_schema.names).cast(_piece_schema))
    return f"{folder}/{name}"


def _got(path: str) -> pa.Table:
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as file:
        return pa.ipc.open_file(file).read_all()


def _search(k: int, cell_rows: int, folder: str | None = None):
    """folder: where the pieces of cells that aren't whole are put; without it, they aren't kept."""

    def done(part: pa.Table, is_cut: bool) -> pa.RecordBatch:
        entries, first = _records(part.column("vector"), _ENTRY)
        row, other, sim = nearest(first, entries >> np.uint32(8), _SCALE[entries & np.uint32(255)], k)
        release()
        cell, rid = part.column("cell")[0].as_py(), part.column("rid").to_numpy()
        # a block is named by its cell and first row
        name = int(mix64(np.array([cell], np.int64).view(_U) ^ mix64(rid[:1].view(_U)))[0] >> _U(1))
        block = pa.array([name if part.column("turn")[0].as_py() == 0 else None] * len(rid), pa.int64())
        # what in_pieces needs of a cell that isn't whole, told once by the first row
        whole, piece = [None] * len(rid), [None] * len(rid)
        if folder and (is_cut or cell & SPLITS):
            whole[0] = cell >> SPLIT_BITS
            piece[0] = _put(part.filter(pa.array(~surplus(part.column("vector").combine_chunks(), k))), folder)
        return pa.RecordBatch.from_arrays([*_lists(rid, row, other, sim), block, pa.array(whole, pa.int64()), pa.array(piece, pa.string())], schema=_found_schema)

    def cut(held: list, last: bool, is_cut: bool):
        """Blocks of what is held of one cell: all of it if it ends here and fits, and a first block if it is too much. is_cut: blocks of this cell went before."""
        table = pa.Table.from_batches(held).combine_chunks()
        words = np.cumsum(pc.binary_length(table.column("vector")).to_numpy() // _ENTRY.itemsize)
        at = 0
        while at < table.num_rows:
            left = table.num_rows - at
            most = max(1, int(np.searchsorted(words - (words[at - 1] if at else 0), CELL_WORDS, "right")) - at)
            if left <= min(most, 2 * cell_rows - 1):
                break
            to = at + min(most, cell_rows)
            yield done(table.slice(at, to - at), is_cut or to < table.num_rows or not last), None
            at, is_cut = to, True
        if at < table.num_rows:
            yield (done(table.slice(at), is_cut), None) if last else (None, table.slice(at).to_batches())

    def run(batches):
        held: list = []
        size, is_cut, at = 0, False, None
        for b in batches:
            cell = b.column("cell").to_numpy()
            edges = [*np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist(), len(cell)] if len(cell) else []
            for x, y in zip(edges, edges[1:]):
                if at != cell[x]:
                    if held:
                        yield from (out for out, _ in cut(held, True, is_cut))
                    held, size, is_cut, at = [], 0, False, cell[x]
                held.append(b.slice(x, y - x))
                size += y - x
                if size >= 2 * cell_rows or sum(h.column("vector").nbytes for h in held) > CELL_WORDS * _ENTRY.itemsize:
                    rest: list = []
                    for out, left in cut(held, False, is_cut):
                        if out is not None:
                            is_cut = True
                            yield out
                        rest = left or rest
                    held, size = rest, sum(h.num_rows for h in rest)
        if held:
            yield from (out for out, _ in cut(held, True, is_cut))

    return run


def fit_cells(rows: DataFrame, n: int, cell_rows: int) -> Broadcast:
    """([(centres, cells of each cluster) of each order], {hot MinHash: in how many pieces its rows are spread})."""
    have = rows.where("n_words > 0")
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = have.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else have
    points = _dense(*_records(drawn.orderBy("rid").select("vector").toArrow().column(0), _ENTRY))
    fitted = []
    for r in range(ORDERS):
        centre = fit_clusters(points, max(1, min(CLUSTERS, n // cell_rows)), SEED + r)
        drawn_in = np.bincount((points @ centre.T).argmax(axis=1), minlength=len(centre)) if len(points) else np.zeros(len(centre))
        fitted.append((centre, np.maximum(1, drawn_in / max(1, len(points)) * n // cell_rows).astype(np.int64)))
    # at most 10,000 an order, by their least count
    hot_from = max(2 * cell_rows, n // 10_000)
    hot = have.select(F.explode("mh").alias("mh")).groupBy("mh").agg(F.count("*").alias("n")).where(F.col("n") > hot_from)
    splits = {r["mh"]: min(SPLITS, -(-r["n"] // cell_rows)) for r in hot.collect()}
    return rows.sparkSession.sparkContext.broadcast((fitted, splits))


def in_cells(rows: DataFrame, n: int, k: int, cell_rows: int, orders=range(ORDERS), held: Broadcast | None = None, folder: str | None = None) -> DataFrame:
    """(rid, others, sims, block, whole, piece) of each row with a vector, once for each of the orders; block is the cell's piece in the first order, null in the others.

    Neighbours are those of a piece. Of a cell in several pieces, the first row of each has the cell's name (whole) and the file in folder with the piece's vectors, for in_pieces to compare the pieces with each other.
    """
    spark = rows.sparkSession
    width = max(1, common.shuffle_width(spark))
    held, folder = held or fit_cells(rows, n, cell_rows), folder or common.scratch_path(spark, "packing-pieces")

    def spread(batches):
        fitted, splits = held.value
        fitted = [fitted[r] for r in orders]
        for b in batches:
            entries, first = _records(b.column("vector"), _ENTRY)
            owns = [np.zeros(b.num_rows, np.int64) for _ in fitted]
            for i in range(0, b.num_rows, 2048):
                j = min(i + 2048, b.num_rows)
                x = _dense(entries[first[i] : first[j]], first[i : j + 1] - first[i])
                for own, (centre, _) in zip(owns, fitted):
                    own[i:j] = (x @ centre.T).argmax(axis=1)
            rid = b.column("rid").to_numpy()
            mh = b.column("mh").combine_chunks() if isinstance(b.column("mh"), pa.ChunkedArray) else b.column("mh")
            mh = mh.flatten().to_numpy().reshape(-1, ORDERS)
            for r, own, (_, parts) in zip(orders, owns, fitted):
                value = np.ascontiguousarray(mh[:, r])
                piece = ((value.view(_U) >> _U(11)).astype(np.float64) / (1 << 53) * parts[own]).astype(np.int64)
                split = np.array([splits.get(v, 0) for v in value.tolist()], np.int64) if splits else np.zeros(len(value), np.int64)
                salt = np.where(split > 0, mix64(rid.view(_U)) % np.maximum(split, 1).view(_U) + _U(1), _U(0)) if splits else np.zeros(len(value), _U)
                hot_cell = np.where(split > 0, value, piece)
                cell = mix64(mix64(hot_cell.view(_U)) + (own.astype(_U) * _U(ORDERS) + _U(r)) * _U(0xD1B54A32D192ED03))
                cell = (cell & ~_U(SPLITS)) | (salt & _U(SPLITS))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), r, np.int32)), pa.array(cell.view(np.int64)), pa.array(value), b.column("rid"), b.column("vector")], names=["turn", "cell", "near", "rid", "vector"])

    celled = rows.where("n_words > 0").select("rid", "mh", "vector").mapInArrow(spread, "turn int, cell bigint, near bigint, rid bigint, vector binary")
    return celled.repartition(width, "cell").sortWithinPartitions("cell", "near", "rid").mapInArrow(_search(k, cell_rows, folder), _FOUND)


def _across(k: int, cell_rows: int):
    def pieces(t: pa.Table):
        """Two of them hold no more rows and words than a cell may, or a row each."""
        words = np.cumsum(pc.binary_length(t.column("vector")).to_numpy() // _ENTRY.itemsize)
        at = 0
        while at < t.num_rows:
            most = max(1, int(np.searchsorted(words - (words[at - 1] if at else 0), CELL_WORDS // 2, "right")) - at)
            yield t.slice(at, to := min(most, cell_rows))
            at += to

    def run(batches):
        """The neighbours of the rows of one piece in the other, and the other way round, for each pair of pieces."""
        for b in batches:
            for one, two in zip(b.column("one").to_pylist(), b.column("two").to_pylist()):
                second = list(pieces(_got(two)))
                for x in pieces(_got(one)):
                    for y in second:
                        both = pa.concat_tables([x, y])
                        entries, first = _records(both.column("vector"), _ENTRY)
                        row, other, sim = nearest(first, entries >> np.uint32(8), _SCALE[entries & np.uint32(255)], k, x.num_rows)
                        yield pa.RecordBatch.from_arrays(_lists(both.column("rid").to_numpy(), row, other, sim), schema=_near_schema)
                        release()

    return run


def in_pieces(found: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """(rid, others, sims): the k nearest of each row in each other piece of its cell, for all cells in several pieces; every two pieces meet in one task, which reads their files."""
    width = max(1, common.shuffle_width(found.sparkSession))
    names = found.where("whole IS NOT NULL").select("whole", "piece")
    pairs = names.withColumnRenamed("piece", "one").join(names.withColumnRenamed("piece", "two"), "whole").where("one < two").select("one", "two")
    return pairs.repartition(4 * width, "one", "two").mapInArrow(_across(k, cell_rows), _NEAR)


def _postings(batches):
    for b in batches:
        records, first = _records(b.column("rare"), _RECORD)
        count = np.diff(first)
        rid = np.repeat(b.column("rid").to_numpy(), count)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(records["word"])), pa.array(rid), pa.array(np.ascontiguousarray(records["value"]))], names=["word", "rid", "value"])


def pair_sums(word: np.ndarray, rid: np.ndarray, value: np.ndarray, piece: int = PIECE):
    """Pieces (row, neighbour, sum of products) over all pairs of rows of each word, row < neighbour; word is sorted. A pair is in several pieces if its words are."""
    n = len(word)
    if not n:
        return
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    count = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n))) - np.arange(n) - 1
    ends = np.cumsum(count)
    held, local = np.unique(rid, return_inverse=True)
    at = 0
    while at < n:
        # a posting's pairs are never cut, and there are fewer than its word's postings
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + piece, "right")))
        c = count[at:to]
        one = np.repeat(np.arange(at, to), c)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(c) - c, c)
        a, b = local[one], local[two]
        key = np.minimum(a, b) * len(held) + np.maximum(a, b)
        product = value[one] * value[two]
        o = np.argsort(key, kind="stable")
        key, product = key[o], product[o]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        if len(first):
            key, product = key[first], np.add.reduceat(product, first)
            a, b = key // len(held), key % len(held)
            yield held[a[a != b]], held[b[a != b]], product[a != b]
        at = to


def _cut_lists(row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """Lists of at most LISTED entries, as rows of batches are counted and not weighed; row is sorted."""
    place = np.arange(len(row)) - np.searchsorted(row, row)
    first = np.flatnonzero(place % LISTED == 0)
    offsets = pa.array(np.append(first, len(row)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(row[first]), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(sim.astype(np.float32)))], names=["rid", "others", "sims"])


def _pairs(batches):
    def done(t: pa.Table):
        for row, other, sim in pair_sums(t.column("word").to_numpy(), t.column("rid").to_numpy(), t.column("value").to_numpy()):
            yield _cut_lists(row, other, sim)

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        # the last word may go on in the next batch, and is never cut
        cut = int(np.searchsorted(b.column("word").to_numpy(), b.column("word")[b.num_rows - 1].as_py()))
        if sum(x.num_rows for x in held) < CHUNK or not cut:
            continue
        yield from done(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield from done(pa.Table.from_batches(held))


def _totals(batches):
    """Rows (rid, others, sims), sorted by rid, whose sims are parts of sums: the pairs whose sum is at least RARE_FROM, from both sides."""

    def done(t: pa.Table):
        lists = t.column("others").combine_chunks()
        rid = np.repeat(t.column("rid").to_numpy(), np.diff(lists.offsets.to_numpy()))
        other, sim = lists.flatten().to_numpy(), t.column("sims").combine_chunks().flatten().to_numpy()
        o = np.lexsort((other, rid))
        rid, other, sim = rid[o], other[o], sim[o]
        first = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (other[1:] != other[:-1]))[: len(rid)])
        if not len(first):
            return
        sim = np.add.reduceat(sim, first)
        near = sim >= RARE_FROM
        rid, other, sim = rid[first][near], other[first][near], sim[near]
        rid, other, sim = np.append(rid, other), np.append(other, rid), np.append(sim, sim)
        o = np.argsort(rid, kind="stable")
        yield _cut_lists(rid[o], other[o], sim[o])

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        rid = b.column("rid").to_numpy()
        held.append(b)
        if cut := int(np.searchsorted(rid, rid[-1])):
            yield from done(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
            held = [b.slice(cut)]
    if held:
        yield from done(pa.Table.from_batches(held))


def _best(k: int):
    """Rows (rid, others, sims), sorted by rid: the k best distinct neighbours of each rid, the nearest first. Of what a pair has in several rows, the best is taken."""

    def done(t: pa.Table) -> pa.RecordBatch:
        lists = t.column("others").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        rid = np.repeat(t.column("rid").to_numpy(), count)
        other, sim = lists.flatten().to_numpy(), t.column("sims").combine_chunks().flatten().to_numpy()
        o = np.lexsort((sim, other, rid))
        rid, other, sim = rid[o], other[o], sim[o]
        last = np.append((rid[1:] != rid[:-1]) | (other[1:] != other[:-1]), True)[: len(rid)]
        rid, other, sim = rid[last], other[last], sim[last]
        o = np.lexsort((other, -sim, rid))
        rid, other, sim = rid[o], other[o], sim[o]
        own, first = np.unique(rid, return_index=True)
        rank = np.arange(len(rid)) - np.repeat(first, np.diff(np.append(first, len(rid))))
        rid, other, sim = rid[rank < k], other[rank < k], sim[rank < k]
        own, first = np.unique(rid, return_index=True)
        offsets = pa.array(np.append(first, len(rid)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(sim))], names=["rid", "others", "sims"])

    def run(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(["rid", "others", "sims"])
            rid = b.column("rid").to_numpy()
            cut = int(np.searchsorted(rid, rid[-1]))
            if cut:
                yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def walk(n: int, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """The greedy low-degree-first paths over documents 0 to n - 1, which are numbered by their ids' order, and all degrees.

    Edges are undirected. Degrees are those of the whole graph.
    """
    a, b, s = np.concatenate([row, other]), np.concatenate([other, row]), np.concatenate([sim, sim])
    o = np.lexsort((b, -s, a))
    a, b, s = a[o], b[o], s[o]
    # an edge that both ends name counts once
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    first = np.searchsorted(a, np.arange(n + 1)).tolist()
    degree = np.diff(first)
    starts = np.lexsort((np.arange(n), degree)).tolist()
    to, seen, paths = b.tolist(), bytearray(n), []
    for at in starts:
        path = []
        while at is not None and not seen[at]:
            seen[at] = 1
            path.append(at)
            at = next((x for x in to[first[at] : first[at + 1]] if not seen[x]), None)
        if path:
            paths.append(path)
    return paths, degree


def by_rare_words(rows: DataFrame) -> DataFrame:
    """(rid, others, sims): all neighbours of each row by its rarest words; a row may have several lists."""
    width = max(1, common.shuffle_width(rows.sparkSession))
    postings = rows.where("n_words > 0").select("rid", "rare").mapInArrow(_postings, "word bigint, rid bigint, value float")
    found = postings.repartition(width, "word").sortWithinPartitions("word", "rid").mapInArrow(_pairs, _NEAR)
    return found.repartition(width, "rid").sortWithinPartitions("rid").mapInArrow(_totals, _NEAR)


def _freed(df: DataFrame, name: str) -> DataFrame:
    """df written, and the files of its shuffles deleted thereafter, as nothing reads them again."""
    conf = df.sparkSession.conf
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key)
    conf.set(key, "true")
    try:
        return common.written(df, name)
    finally:
        conf.set(key, was)


def graph(rows: DataFrame, n: int, k: int = NEIGHBOURS, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """((rid, others, sims): the k best neighbours of each row; (rid, block): where each is walked)."""
    width = max(1, common.shuffle_width(rows.sparkSession))
    held = fit_cells(rows, n, cell_rows)
    both, turns = by_rare_words(rows), []
    # one order after the other, so that the vectors of one alone lie in shuffles and pieces
    for r in range(ORDERS):
        folder = common.scratch_path(rows.sparkSession, "packing-pieces")
        turns.append(_freed(in_cells(rows, n, k, cell_rows, [r], held, folder), "packing-found"))
        both = both.unionByName(turns[r].select("rid", "others", "sims")).unionByName(_freed(in_pieces(turns[r], k, cell_rows), "packing-met"))
        common.remove(rows.sparkSession, folder)
    best = both.repartition(width, "rid").sortWithinPartitions("rid").mapInArrow(_best(k), _NEAR)
    return _freed(best, "packing-graph"), turns[0].where("block IS NOT NULL").select("rid", "block")


def _walked(rows: DataFrame, best: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every row with words: its block, its path (the row that begins it), the words before it there; rows that begin a path tell its place, end, degree and words."""
    kind = dict(rows.dtypes)["doc_id"]
    joined = blocks.join(rows.select("rid", "doc_id", "n_words"), "rid").join(best, "rid", "left")

    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("rid", "ascending")])
        rid = table.column("rid").to_numpy()
        n = len(rid)
        order = np.argsort(rid)
        lists = table.column("others").combine_chunks()
        count = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(int)
        row, other, sim = np.repeat(np.arange(n), count), lists.flatten().to_numpy(), table.column("sims").combine_chunks().flatten().to_numpy()
        at = np.minimum(np.searchsorted(rid[order], other), n - 1)
        here = rid[order][at] == other
        paths, degree = walk(n, row[here], order[at[here]], sim[here])
        to = np.concatenate([np.array(p) for p in paths])
        size = np.array([len(p) for p in paths])
        begin = np.cumsum(size) - size
        words = table.column("n_words").to_numpy()[to]
        total = np.cumsum(words)
        before = total - words - np.repeat(total[begin] - words[begin], size)
        first = np.isin(np.arange(n), begin)
        on_first = lambda x: pa.array(np.repeat(x, size), pa.int64(), mask=~first)
        return pa.table(
            {
                "block": table.column("block"), "rid": rid[to], "doc_id": table.column("doc_id").take(pa.array(to)), "n_words": words, "path": np.repeat(rid[to[begin]], size), "before": before,
                "seq": on_first(np.arange(len(size))), "tail": on_first(rid[to[begin + size - 1]]), "degree": on_first(degree[to[begin]]), "path_words": on_first(np.add.reduceat(words, begin)),
            }
        )

    return common.written(joined.groupBy("block").applyInArrow(go, f"block bigint, rid bigint, doc_id {kind}, n_words bigint, path bigint, before bigint, seq bigint, tail bigint, degree bigint, path_words bigint"), "packing-walked")


def _joins(paths: DataFrame, best: DataFrame) -> DataFrame:
    """(path, next): which path goes on with which. Each has one next and one before at most, of a higher (degree, id), so that there are no circles."""
    edges = best.select("rid", F.explode(F.arrays_zip("others", "sims")).alias("e")).select("rid", F.col("e.others").alias("other"), F.col("e.sims").alias("sim"))
    edges = edges.unionByName(edges.select(F.col("other").alias("rid"), F.col("rid").alias("other"), "sim"))
    ends, heads = paths.select(F.col("tail").alias("rid"), "path", "degree"), paths.select(F.col("path").alias("other"), F.col("degree").alias("of_other"))
    open_ = edges.join(ends, "rid").join(heads, "other").where("struct(degree, path) < struct(of_other, other)").groupBy("path", F.col("other").alias("next")).agg(F.max("sim").alias("sim"))
    open_, done = common.written(open_, "packing-ends"), []
    while not open_.isEmpty():
        wished = open_.groupBy("path").agg(F.max(F.struct("sim", (-F.col("next")).alias("to"))).alias("w")).select("path", (-F.col("w.to")).alias("next"), "w.sim")
        taken = wished.groupBy("next").agg(F.max(F.struct("sim", (-F.col("path")).alias("by"))).alias("w")).select((-F.col("w.by")).alias("path"), "next")
        done.append(common.written(taken, "packing-joins"))
        open_ = common.written(open_.join(done[-1].select("path"), "path", "left_anti").join(done[-1].select("next"), "next", "left_anti").select("path", "next", "sim"), "packing-ends")
    spark = paths.sparkSession
    out = spark.createDataFrame([], "path bigint, next bigint")
    for d in done:
        out = out.unionByName(d)
    return out


def _starts(paths: DataFrame, joins: DataFrame) -> DataFrame:
    """(path, home, start): the block in whose windows each path lies, and the words before it there. Places along joined paths are found by pointer doubling."""
    words = paths.select("path", "path_words")
    back = joins.join(words, "path").select(F.col("next").alias("path"), F.col("path").alias("up"), F.col("path_words").alias("dist"))
    tops = joins.select("path").join(joins.select(F.col("next").alias("path")), "path", "left_anti").select("path", F.col("path").alias("up"), F.lit(0).cast("bigint").alias("dist"))
    now = common.written(back.unionByName(tops), "packing-places")
    while True:
        above = now.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        step = common.written(now.join(above, "up").select("path", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("up") != F.col("up2")).alias("moved")), "packing-places")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    placed = paths.join(now, "path", "left").withColumn("top", F.coalesce("up", "path")).withColumn("dist", F.coalesce("dist", F.lit(0).cast("bigint")))
    total = placed.groupBy("top").agg(F.sum("path_words").alias("total"))
    in_order = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    based = paths.join(total, F.col("path") == F.col("top")).select("top", F.col("block").alias("home"), F.coalesce(F.sum("total").over(in_order), F.lit(0).cast("bigint")).alias("base"))
    return placed.join(based, "top").select("path", "home", (F.col("base") + F.col("dist")).alias("start"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = WINDOW_WORDS, k: int = NEIGHBOURS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(cell, window, doc_ids, first_words, n_words): the pieces of each window in their order.

    A piece is the words first_words to first_words + n_words - 1 of its document. All windows of a cell but the last hold window_words words.
    """
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    rows, n = _placed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    best, blocks = graph(rows, n, k, cell_rows)
    walked = _walked(rows, best, blocks)
    paths = walked.where("seq IS NOT NULL").select("block", "path", "seq", "tail", "degree", "path_words")
    starts = _starts(paths, _joins(paths, best))
    size = F.lit(window_words).cast("bigint")
    placed = walked.join(starts, "path").select("home", "rid", "doc_id", "n_words", (F.col("start") + F.col("before")).alias("at"))
    cut = placed.select("*", F.explode(F.sequence(F.expr(f"at div {window_words}L"), F.expr(f"(at + n_words - 1) div {window_words}L"))).alias("window"))
    begin, end = F.greatest("at", F.col("window") * size), F.least(F.col("at") + F.col("n_words"), (F.col("window") + 1) * size)
    piece = F.struct(begin.alias("begin"), "doc_id", (begin - F.col("at")).alias("first_word"), (end - begin).alias("words"))
    held = cut.groupBy("home", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    named = ["cell", "window", "doc_ids", "first_words", "n_words"]
    full = held.select("home", "window", F.col("p.doc_id"), F.col("p.first_word"), F.col("p.words")).toDF(*named)
    # rows without words by their number, so that they too are spread
    none = rows.where("n_words = 0").groupBy((-1 - F.expr(f"rid div {cell_rows}L")).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("rid", "doc_id"))).alias("p"))
    zeros = F.transform("p", lambda _: F.lit(0).cast("bigint"))
    return full.unionByName(none.select("cell", F.lit(0).cast("bigint").alias("window"), F.col("p.doc_id").alias("doc_ids"), zeros.alias("first_words"), zeros.alias("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

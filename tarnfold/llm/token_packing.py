"""Packed token-id matrices: best-fit-decreasing with a segment tree, written as binary.

1. A task encodes its documents whole, with the ranks and the pattern of a public tokenizer.
2. A document of more than row_tokens ids is cut into full rows and a rest; ids are never lost, added or reordered within a document.
3. Within a task, pieces are placed from the longest to the shortest, each into the open row with the least room that is enough.
   A segment tree over capacities finds it in log(row_tokens) steps. Rows are filled up with pad_id.
4. Each row carries its ids as little-endian binary, the cumulative lengths of its segments, and the positions, which start again
   at 0 with every segment. write_matrices stores the same as flat files.

One scan without a shuffle: rows are packed from documents of the same task, so each task has at most a few rows that are not full.

Defined results: null texts and empty texts have no ids and are in no row. Equal lengths are placed by document id (nulls last) and offset, into the lowest-numbered row
of those with the same room. Rows that repeat are packed as often as they occur. Other columns are ignored. An empty table gives no rows. Texts are encoded whole, of any length;
strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text_kernel import slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
ROW_TOKENS = 2048
PAD_ID = 50256


def load_encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(encoding, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and where each text's begin."""
    got = [encoding.encode_to_numpy(x, disallowed_special=()) if x else np.zeros(0, np.uint32) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] numbers, then those of begin[1] and so on."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = begin - np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.repeat(shift, size) + np.arange(total)


class Capacities:
    """Open rows by the room they have left: the least room that is enough, in log steps."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.any = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        heapq.heappush(self.rows[room], row)
        node = self.base + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the best fit, which leaves the tree."""
        node = self.base + need
        if not self.any[node]:
            # up to the first right sibling that holds something, then down its left side
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.base
        row = heapq.heappop(self.rows[room])
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return room, row


def best_fit(sizes: list[int], row_tokens: int) -> list[list[int]]:
    """Pieces of each row, for sizes that descend."""
    rows: list[list[int]] = []
    free = Capacities(row_tokens)
    for piece, size in enumerate(sizes):
        found = free.take(size)
        room, row = found or (row_tokens, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > size:
            free.add(room - size, row)
    return rows


_SCHEMA = "shard int, row bigint, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_offsets array<bigint>, n_tokens bigint"


def _width(pad_id: int, vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if max(pad_id, vocabulary - 1) < 1 << 16 else np.dtype("<u4")


def pack_shard(ids: list, tokens: np.ndarray, first: np.ndarray, row_tokens: int, pad_id: int, dtype: np.dtype):
    """Rows of one task: (input_ids, cu_seqlens, doc indexes, doc offsets)."""
    size = np.diff(first)
    pieces = -(-size // row_tokens)
    doc = np.repeat(np.arange(len(size)), pieces)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * row_tokens
    length = np.minimum(size[doc] - at, row_tokens)
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
    o = np.lexsort((at, rank[doc], -length))
    doc, at, length = doc[o], at[o], length[o]
    for row in best_fit(length.tolist(), row_tokens):
        n = length[row]
        used = int(n.sum())
        out = np.full(row_tokens, pad_id, dtype)
        out[:used] = tokens[_ranges(first[doc[row]] + at[row], n)]
        yield out, np.concatenate([[0], np.cumsum(n)]), doc[row], at[row]


def positions_of(cu: np.ndarray, row_tokens: int, dtype: np.dtype) -> np.ndarray:
    """Positions within a row, from 0 in each segment and in the filling."""
    edges = np.append(cu, row_tokens) if cu[-1] < row_tokens else cu
    return _ranges(np.zeros(len(edges) - 1, np.int64), np.diff(edges)).astype(dtype)


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, row_tokens: int = ROW_TOKENS, pad_id: int = PAD_ID) -> DataFrame:
    """One row for each row of the matrix: shard, row, input_ids, position_ids, cu_seqlens, doc_ids, doc_offsets, n_tokens.

    input_ids and position_ids hold row_tokens numbers of 2 bytes (4 where ids or positions need it). Segment i is cu_seqlens[i] to cu_seqlens[i + 1]
    of the row, and the ids from doc_offsets[i] on of document doc_ids[i]. n_tokens counts ids without filling.
    """
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]

    def run(batches):
        encoding = load_encoding(ranks)
        dtype = _width(pad_id, encoding.max_token_value + 1)
        position = np.dtype("<u2") if row_tokens <= 1 << 16 else np.dtype("<u4")
        ids, tokens, sizes, id_type = [], [], [], None
        for piece in slices(batches, "text"):
            found, first = encode(encoding, piece.column("text"))
            tokens.append(found.astype(dtype))
            sizes.append(np.diff(first))
            ids += piece.column("doc_id").to_pylist()
            id_type = piece.column("doc_id").type
        if not ids:
            return
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        shard, held = TaskContext.get().partitionId(), []
        names = ["shard", "row", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets", "n_tokens"]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64()), pa.int64()]
        flat = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
        for n, (row, cu, doc, at) in enumerate(pack_shard(ids, np.concatenate(tokens), first, row_tokens, pad_id, dtype)):
            held.append((shard, n, row.tobytes(), positions_of(cu, row_tokens, position).tobytes(), cu.tolist(), [ids[i] for i in doc], at.tolist(), int(cu[-1])))
            if len(held) == 1000:
                yield flat()
                held = []
        if held:
            yield flat()

    return narrow.mapInArrow(run, _SCHEMA.format(kind=kind))


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Write packed rows as flat files that can be mapped into memory, and list them: (path, n_rows, n_segments).

    For each task: name.ids.bin and name.positions.bin, matrices row by row; name.seqlens.bin, uint32, every row's count of segments and
    then its cumulative lengths without the first 0. A repeated task writes other names; only listed files count.
    """

    def run(batches):
        name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        system, inner = pafs.FileSystem.from_uri(name)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        rows = segments = 0
        with system.open_output_stream(inner + ".ids.bin") as a, system.open_output_stream(inner + ".positions.bin") as b, system.open_output_stream(inner + ".seqlens.bin") as c:
            for batch in batches:
                for ids, positions, cu in zip(*(batch.column(x) for x in ("input_ids", "position_ids", "cu_seqlens"))):
                    a.write(ids.as_buffer())
                    b.write(positions.as_buffer())
                    lengths = cu.as_py()[1:]
                    c.write(np.array([len(lengths), *lengths], "<u4").tobytes())
                    rows, segments = rows + 1, segments + len(lengths)
        yield pa.RecordBatch.from_pydict({"path": [name], "n_rows": [rows], "n_segments": [segments]})

    return common.written(packed.select("input_ids", "position_ids", "cu_seqlens").mapInArrow(run, "path string, n_rows bigint, n_segments bigint"), "matrices")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

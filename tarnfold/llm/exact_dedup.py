"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition hashes its texts to 48 bits, sorts the hashes, cuts the range of hashes into one
   piece per owner and sends every owner its piece as a Golomb-Rice code of the gaps.
2. An owner decodes the pieces of all partitions and answers each with a bitmap: which of its
   hashes occur more than once anywhere.
3. The partition applies the bitmap to the piece that it kept, which leaves a list of suspect hashes.
4. A second scan, cut into the same partitions (common.pin_scans), passes only suspect documents on. They alone are shuffled with their text, and
   equality of the bytes decides; hashes that merely collide drop out here.

Nothing is broadcast or collected. What is exchanged is about five bytes a document.

Defined results: the kept row of a group is the one with the smallest id (null ids last). Null texts
are no copies of anything; empty texts are copies of each other; rows that repeat, id and all, are copies
of each other, so that duplicate_of may equal doc_id. Texts are compared whole, of any length. Empty tables
give empty results. Other columns, whatever their names, are passed on by drop_copies and ignored by find_copies.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FINGERPRINT_BITS = 48
_MASK = (1 << FINGERPRINT_BITS) - 1


def rice_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of ascending uint64 values: header, unary quotients of the gaps, then their remainders."""
    n = len(values)
    if not n:
        return struct.pack("<QQB", 0, 0, 0)
    gaps = np.diff(values)
    mean = int(values[-1] - values[0]) // max(1, n - 1)
    k = max(0, mean.bit_length() - 1)
    head = struct.pack("<QQB", n, int(values[0]), k)
    if n == 1:
        return head
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n - 1, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return head + struct.pack("<Q", len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    n, first, k = struct.unpack_from("<QQB", code)
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(n, first, np.uint64)
    if n == 1:
        return out
    (length,) = struct.unpack_from("<Q", code, 17)
    body = np.frombuffer(code, np.uint8, offset=25)
    cut = (length + 7) // 8
    stops = np.flatnonzero(np.unpackbits(body[:cut], count=length))
    quotient = np.diff(stops, prepend=-1) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(body[cut:], count=(n - 1) * k).reshape(n - 1, k).astype(np.uint64)
        gaps += (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    out[1:] += np.cumsum(gaps)
    return out


def _owner_bounds(owners: int) -> np.ndarray:
    return np.array([(i << FINGERPRINT_BITS) // owners for i in range(1, owners)], dtype=np.uint64)


def _send(owners: int):
    bounds = _owner_bounds(owners)

    def run(batches):
        part = TaskContext.get().partitionId()
        held = [b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        cuts = [0, *np.searchsorted(values, bounds).tolist(), len(values)]
        rows = [(o, a, b) for o, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([o for o, _, _ in rows], pa.int32()),
                pa.array([part] * len(rows), pa.int32()),
                pa.array([rice_encode(values[a:b]) for _, a, b in rows], pa.binary()),
            ],
            names=["owner", "part", "code"],
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One owner's work: bitmaps of the hashes that occur more than once."""
    pieces = [rice_decode(c.as_py()) for c in table.column("code")]
    values = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out, at = [], 0
    for p in pieces:
        bits = twice[at : at + len(p)]
        out.append(np.packbits(bits).tobytes() if bits.any() else b"")
        at += len(p)
    return pa.table({"owner": table.column("owner"), "part": table.column("part"), "code": table.column("code"), "bitmap": pa.array(out, pa.binary())})


def _apply(batches):
    """A sender's work: its own hashes under the bitmap are suspect."""
    for b in batches:
        found = []
        for code, bitmap in zip(b.column("code").to_pylist(), b.column("bitmap").to_pylist()):
            if bitmap:
                values = rice_decode(code)
                found.append(np.unique(values[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)]))
            else:
                found.append(np.zeros(0, np.uint64))
        yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([f.view(np.int64).tolist() for f in found], pa.list_(pa.int64()))], names=["part", "suspects"])


def suspects_of(where: tuple[str, int], part: int) -> np.ndarray:
    """The suspect hashes of one partition, from the written answers."""
    lists = common.read_part(where, part, pa.schema([("suspects", pa.list_(pa.int64()))])).column(0)
    flat = [x.values.to_numpy(zero_copy_only=False) for x in lists if x.is_valid and len(x.values)]
    return np.unique(np.concatenate(flat)) if flat else np.zeros(0, np.int64)


def _suspect_rows(docs: DataFrame, text_col: str, fp: str, owners: int | None) -> DataFrame:
    """All rows of docs with their fingerprint, null where no other row has it; the text decides later."""
    spark = docs.sparkSession
    owners = owners or max(1, common.shuffle_width(spark))
    print_of = F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col).bitwiseAND(F.lit(_MASK)))
    sent = docs.select(print_of.alias("fp")).mapInArrow(_send(owners), "owner int, part int, code binary")
    answered = sent.groupBy("owner").applyInArrow(_answer, "owner int, part int, code binary, bitmap binary")
    lists = answered.where(F.length("bitmap") > 0).mapInArrow(_apply, "part int, suspects array<bigint>")
    where = common.written_by_part(lists, "suspects")

    def keep(batches):
        known = None
        for b in batches:
            if known is None:
                known = suspects_of(where, TaskContext.get().partitionId())
            at = b.schema.get_field_index(fp)
            col = b.column(at)
            values = col.fill_null(-1).to_numpy(zero_copy_only=False)
            mask = ~np.isin(values, known, kind="sort" if len(known) else None)
            yield b.set_column(at, b.schema.field(at), pa.array(values, pa.int64(), mask=mask))

    tagged = docs.withColumn(fp, print_of)
    return tagged.mapInArrow(keep, tagged.schema)


def _stable(docs: DataFrame) -> DataFrame:
    common.pin_scans(docs.sparkSession)
    return docs if common.is_plain_scan(docs) else common.written(docs, "dedup-input")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """(doc_id, duplicate_of): every row that is a byte-for-byte copy, and the kept row's id. See the module for edge cases."""
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    narrow = _stable(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = _suspect_rows(narrow, "text", "fp", owners).where(F.col("fp").isNotNull())
    w = Window.partitionBy("fp", "text").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = rows.select("doc_id", F.first("doc_id").over(w).alias("duplicate_of"), F.row_number().over(w).alias("rank"))
    return ranked.where("rank > 1").select("doc_id", "duplicate_of")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """docs without the rows that find_copies names; its columns, and those of no other name."""
    names = docs.columns
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    docs = _stable(docs)
    fp, rank = common.free_name(docs, "fingerprint_48"), common.free_name(docs, "rank_of_copy")
    tagged = _suspect_rows(docs, text_col, fp, owners)
    w = Window.partitionBy(fp, text_col).orderBy(F.col(id_col).asc_nulls_last())
    judged = tagged.where(F.col(fp).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1)
    return tagged.where(F.col(fp).isNull()).select(*docs.columns).unionByName(judged.select(*docs.columns)).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """All byte-for-byte copies in the documents table."""
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rank
  FROM documents WHERE text IS NOT NULL
) WHERE rank > 1
"""

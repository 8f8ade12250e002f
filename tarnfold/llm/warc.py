"""WARC reading by verified boundary chains.

1. Files are cut into ranges. A task finds every "WARC/" and version at a line start in its range, reads the header that
   follows, however long it is, and emits a candidate edge: record offset -> offset of its successor (header, content, two line ends).
   Magic inside a payload yields candidates as well.
2. For each file, pointer jumping from offset 0 marks what can be reached: the marked set is doubled along the
   pointers, which are squared in each round. All else was payload and goes.
3. The marked offsets return to their ranges, and tasks read the records' headers and contents.

What is shuffled is 24 bytes a candidate, never content. A record may be longer than a range, and a header may cross from one range
to the next.

Defined results: only records with a header's end, a Content-Length that is a number, and the whole content in the file are part of a chain; a chain ends at the first
that breaks these rules (a cut-off file yields the records before the cut), and broken_files names that place and what the file has left. Records of any version are read. Compressed files have no chain, and are named as well. An empty file has no records. Files that repeat in the list of files are read
once. Headers are matched without case, the first of each name counts; folded header lines are continuations. write_files gives null ids, urls and contents an absent header, and
a content of 0 bytes; read again they are null, null and empty. Rows that repeat are written as often as they occur. Other columns are not written.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable
from . import common

RANGE_BYTES = 32 << 20
HEADER_BYTES = 64 << 10
BATCH_BYTES = 8 << 20
_MAGIC = re.compile(rb"(?:\A|(?<=\n))WARC/[0-9]{1,3}\.[0-9]{1,3}\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.I)


def _open(path: str):
    """The file's random-access handle, from whatever file system its URI names."""
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def candidates(data: bytes, base: int, limit: int, size: int, more=None) -> list[tuple[int, int]]:
    """Edges from record starts in data[:limit]; data begins at offset base of a file of size bytes. more(offset, n) reads n bytes of it where a header goes on after data."""
    found = []
    for m in _MAGIC.finditer(data):
        at = m.start()
        if at >= limit:
            break
        # at the start of a range the line end before it is unseen; the chain decides
        head, read = data, len(data)
        stop = data.find(b"\r\n\r\n", m.end() - 2)
        step = HEADER_BYTES
        while stop < 0 and more and base + read < size:
            # payload that looks like a start can make this read on; what is read doubles, so that it costs twice its length
            head += more(base + read, step)
            stop = head.find(b"\r\n\r\n", max(m.end() - 2, read - 3))
            read, step = len(head), 2 * step
        length = _LENGTH.search(head, m.end() - 2, stop + 4) if stop >= 0 else None
        if length:
            after = base + stop + 4 + int(length[1])
            if after <= size:
                found.append((base + at, after + 4 if after + 4 <= size else size))
    return found


def reachable(offset: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which records the chain from offset 0 visits; offsets ascend, each occurs once."""
    n = len(offset)
    if not n or offset[0] != 0:
        return np.zeros(n, bool)
    at = np.minimum(np.searchsorted(offset, after), n - 1)
    jump = np.append(np.where(offset[at] == after, at, n), n)
    mark = np.zeros(n + 1, bool)
    mark[0] = True
    while True:
        more = mark.copy()
        more[jump[mark]] = True
        jump = jump[jump]
        more[n] = False
        if (more == mark).all():
            return mark[:n]
        mark = more


def _ranges(spark: SparkSession, folder: str, range_bytes: int) -> DataFrame:
    """(path, size, start) of each range of each file in folder, or of the file that folder names."""
    importable(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size")).distinct()
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    cut = files.where("size > 0").select("path", "size", starts.alias("start"))
    return cut.repartition(max(1, common.shuffle_width(spark)), "path", "start")


def find_records(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, after): the verified records of all files."""

    def scan(batches):
        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                with _open(path) as f:
                    # one byte before, to see the line end that precedes a record, and a header's length after
                    lead = min(start, 1)
                    f.seek(start - lead)
                    data = f.read(lead + range_bytes + HEADER_BYTES)

                    def more(at: int, n: int) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    found = [x for x in candidates(data, start - lead, lead + range_bytes, size, more) if x[0] >= start]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["path", "offset", "after"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        return table.filter(pa.array(reachable(table.column("offset").to_numpy(), table.column("after").to_numpy())))

    edges = _ranges(spark, folder, range_bytes).mapInArrow(scan, "path string, offset bigint, after bigint")
    return edges.groupBy("path").applyInArrow(chain, "path string, offset bigint, after bigint")


def broken_files(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, read_until): the files whose chain ends before the file does, as at a record that breaks a rule."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size")).distinct()
    ends = find_records(spark, folder, range_bytes).groupBy("path").agg(F.max("after").alias("read_until"))
    return files.join(ends, "path", "left").select("path", "size", F.coalesce("read_until", F.lit(0).cast("bigint")).alias("read_until")).where("read_until < size")


def headers_of(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            name = key.strip().lower()
            if name in found:
                name = ""
            else:
                found[name] = value.strip()
    return found


def read_files(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, warc_type, record_id, url, headers, content) of every verified record."""
    records = find_records(spark, folder, range_bytes).withColumn("range", F.floor(F.col("offset") / range_bytes))
    spread = records.repartition(max(1, common.shuffle_width(spark)), "path", "range").sortWithinPartitions("path", "offset")
    names = ["path", "offset", "warc_type", "record_id", "url", "headers", "content"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def read(batches):
        handle, of = None, None
        for b in batches:
            rows, size = [], 0
            for path, offset, after in zip(*(b.column(i).to_pylist() for i in range(3))):
                if path != of:
                    if handle:
                        handle.close()
                    handle, of = _open(path), path
                handle.seek(offset)
                data = handle.read(after - offset)
                stop = data.index(b"\r\n\r\n")
                head = headers_of(data[:stop])
                content = data[stop + 4 : stop + 4 + int(head["content-length"])]
                rows.append((path, offset, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), list(head.items()), content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
        if handle:
            handle.close()

    return spread.select("path", "offset", "after").mapInArrow(read, "path string, offset bigint, warc_type string, record_id string, url string, headers map<string,string>, content binary")


def record_bytes(kind: str, ident, url, content: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Record-ID: <urn:page:{ident}>"] if ident is not None else []
    lines += ["WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url)] if url is not None else []
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def write_files(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """One WARC file for each partition of pages, as resource records after a warcinfo record.

    A file appears under its final name when it is complete; an attempt that is repeated writes another file, and only those that
    their task reported are kept.
    """
    pages, id_col, url_col, body_col = common.numbered(pages, id_col, url_col, body_col)
    spark = pages.sparkSession
    folder = folder.rstrip("/")

    def write(batches):
        name = f"{folder}/{uuid.uuid4().hex}.warc"
        system, inner = pafs.FileSystem.from_uri(name)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(record_bytes("warcinfo", None, None, b"software: tarnfold\r\n"))
            for b in batches:
                for ident, url, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                    out.write(record_bytes("resource", ident, url, (body or "").encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    done = {r["name"] for r in pages.select(F.col(id_col).cast("string"), url_col, body_col).mapInArrow(write, "name string").collect()}
    system, inner = pafs.FileSystem.from_uri(folder)
    for info in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
        if info.is_file and info.base_name not in {x.rpartition("/")[2] for x in done}:
            system.delete_file(info.path)


def query(spark, sf_dir: str) -> DataFrame:
    """All pages, written to WARC files in the shared folder and read again by their boundary chains."""
    folder = common.scratch_path(spark, "warc")
    write_files(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = read_files(spark, folder).where("warc_type = 'resource'")
    return back.select(
        F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1).cast("bigint").alias("page_id"),
        "url",
        F.col("content").cast("string").alias("html"),
    )


ORACLE_SQL = "SELECT page_id, url, html FROM pages"

"""Document quality by hierarchical empirical Bayes over sites.

1. A logistic regression on the text's shape and hashed word frequencies is fitted to a sample of at most max_train labelled
   documents; it gives every document a probability of good quality, its own evidence.
2. Grouped sums of the evidence, by path within host and by host, over all documents. Variance within and between the groups sets how many documents'
   worth of evidence the level above counts for: m_path and m_host.
3. A host's posterior is shrunk towards the global mean, a path's towards its host's: (sum + m * above) / (n + m). Sparse sites therefore
   stay near what is above them. A document's own evidence is taken out of both sums first.
4. quality: the document's odds times its path's posterior odds over the global odds, that is, its evidence with the site in place of the global prior.

What is collected is the bounded training sample and one row of sums; sites are joined by shuffle or broadcast, as their size has it.

Defined results: null and empty texts, and texts without words, have evidence from their shape alone. A null host or path is a group of its own. Null labels and labels
without a document train nothing; an id that is labelled twice trains twice. With labels of one kind only, or none, every document's own evidence is the labels' mean
(0.5 without any). Rows that repeat and null ids are judged like all others. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text_kernel import Words, slices, span_hash

MAX_TRAIN = 12_000
BUCKETS = 256
RIDGE = 3.0
KEEP_FROM = 0.3
LEAST, MOST = 0.5, 1e6
_U = np.uint64
_KINDS = (
    (np.r_[48:58], "digits"),
    (np.r_[65:91], "capitals"),
    (np.array([32]), "blanks"),
    (np.array([10]), "line ends"),
    (np.frombuffer(b".", np.uint8), "stops"),
    (np.frombuffer(b",;:", np.uint8), "commas"),
    (np.frombuffer(b"!?", np.uint8), "calls"),
    (np.frombuffer(b"#$%&*@^~", np.uint8), "signs"),
    (np.frombuffer(b"|<>{}[]\\/_=+", np.uint8), "markup"),
    (np.r_[128:256], "beyond ASCII"),
)


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Share of a document's keys that it has had before."""
    o = np.lexsort((key, doc))
    d, k = doc[o], key[o]
    again = np.append(False, (d[1:] == d[:-1]) & (k[1:] == k[:-1]))[: len(d)]
    return np.bincount(d[again], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)


def features(column: pa.Array) -> np.ndarray:
    """One row for each text, float32."""
    w = Words(column)
    n, raw, offsets = len(w.counts), w.raw, w.offsets
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(w.counts, 1)
    out = [np.log1p(np.diff(offsets)), np.log1p(w.counts)]
    for codes, _ in _KINDS:
        table = np.zeros(256, bool)
        table[codes] = True
        out.append(_per_doc(table[raw], offsets) / size)
    doc = w.docs
    length = (w.ends - w.starts).astype(np.float64)
    mean = np.bincount(doc, length, n) / words
    out += [mean, np.sqrt(np.maximum(np.bincount(doc, length**2, n) / words - mean**2, 0)), _repeats(doc, w.hash, n)]
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    out.append(np.bincount(doc[(upper[w.ends] - upper[w.starts] == length) & (length > 1)], minlength=n) / words)
    if len(raw):
        stop = raw == 10
        stop[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(stop) + 1
        starts = np.append(0, ends[:-1])
        owner = np.searchsorted(offsets, starts, "right") - 1
        lines = np.maximum(np.bincount(owner, minlength=n), 1)
        out += [_repeats(owner, span_hash(raw.astype(_U) + _U(1), starts, ends), n), np.log1p(np.diff(offsets) / lines)]
    else:
        out += [np.zeros(n), np.zeros(n)]
    grid = np.bincount(doc * BUCKETS + (w.hash >> _U(56)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.hstack([np.column_stack(out), np.sqrt(grid / words[:, None])]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight + self.bias, -12, 12)


def train(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Model:
    """Ridge logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        width = len(_KINDS) + 8 + BUCKETS
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(p / (1 - p))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    b = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean.astype(np.float64), scale.astype(np.float64), b[:-1], float(b[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """The document classifier, from at most about max_train labelled documents, drawn by a hash of the id."""
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    common.need(labels, "doc_id", label_col)
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    share = min(1.0, max_train / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for piece in slices(batches, "text"):
            x = features(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    # the drawn ids are few at any size, as max_train says
    found = rows.join(F.broadcast(drawn), "id").select("y", "text").mapInArrow(run, "y double, x binary").toArrow()
    y = found.column("y").to_numpy()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(y), len(_KINDS) + 8 + BUCKETS)
    o = np.lexsort((x[:, 0], y))
    return train(x[o], (y[o] > 0.5).astype(np.float64))


def strengths(n: float, groups: float, above: float, sum_n2: float, within: float, between: float) -> float:
    """Documents' worth of the level above: the variance within groups over that between them, by moments.

    within: the sum of squares around the groups' means; between: that of the groups' means around those above, weighted by size; above: the number of groups above.
    """
    if n <= groups or groups <= above:
        return MOST
    inside = within / (n - groups)
    spread = (between - (groups - above) * inside) / max(n - sum_n2, 1e-9)
    return float(min(max(inside / spread, LEAST), MOST)) if spread > 0 else MOST


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, quality, keep) of every row of docs."""
    docs, id_col, text_col, host_col, path_col = common.numbered(docs, id_col, text_col, host_col, path_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))

    def run(batches):
        for piece in slices(batches, "text"):
            p = 1 / (1 + np.exp(-held.value.logit(features(piece.column("text")))))
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("doc_id", "host", "path")] + [pa.array(p)], names=["doc_id", "host", "path", "p"])

    scored = common.written(narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, host string, path string, p double"), "evidence")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = common.written(paths, "path-sums")
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"), F.count("*").alias("paths"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("path_ss"), F.sum(F.col("n") * F.col("n")).alias("path_n2"),
    )
    r = hosts.agg(
        F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.sum("host_q").alias("q"), F.count("*").alias("hosts"), F.sum("paths").alias("paths"), F.sum("path_ss").alias("path_ss"),
        F.sum(F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("host_ss"), F.sum(F.col("host_n") * F.col("host_n")).alias("host_n2"), F.sum(F.col("path_n2") / F.col("host_n")).alias("path_n2"),
    ).first()
    n = r["n"] or 0
    mu = r["s"] / n if n else 0.5
    m_host = strengths(n, r["hosts"], 1, r["host_n2"] / n, r["q"] - r["host_ss"], r["host_ss"] - r["s"] ** 2 / n) if n else MOST
    m_path = strengths(n, r["paths"], r["hosts"], r["path_n2"], r["q"] - r["path_ss"], r["path_ss"] - r["host_ss"]) if n else MOST
    sites = paths.withColumnsRenamed({"host": "h", "n": "path_n", "s": "path_s", "path": "l"}).drop("q").join(hosts.select(F.col("host").alias("g"), "host_n", "host_s"), F.expr("h <=> g")).drop("g")
    both = scored.join(sites, F.expr("host <=> h AND path <=> l"))
    p = F.col("p")
    host = (F.col("host_s") - p + m_host * mu) / (F.col("host_n") - 1 + m_host)
    path = (F.col("path_s") - p + m_path * F.col("host_posterior")) / (F.col("path_n") - 1 + m_path)
    safe = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: safe(c) / (1 - safe(c))
    total = odds(p) * odds(F.col("path_posterior")) / odds(F.lit(mu))
    judged = both.withColumn("host_posterior", host).withColumn("path_posterior", path).withColumn("quality", total / (1 + total))
    return judged.select("doc_id", p.alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= keep_from).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels))

"""Language identification by words first, character n-grams where a word is unknown.

A model holds, for each language, smoothed log frequencies of its commonest words and of character n-grams
of 1 to 5 characters. A known word scores its log frequency in each language. An unknown word is looked up by
its 5-grams; if the model knows none of them, by its 4-grams, and so on down to single characters; the score is the mean over
the known grams of the first length that has any. A word without any known gram scores nothing. A word's grams
run over the word with one space on each side. A document's language has the highest sum.

The model is fitted on about train_per_language labelled documents of each language, drawn by a hash of the text, and keeps
at most max_words words and max_grams grams a length; it is therefore of bounded size and is broadcast.
Scoring is one pass over the documents without a shuffle.

Defined results: null and empty texts and texts without words get language null and are rejected. Ties go to the
alphabetically first language. A document is rejected when its posterior is under min_posterior or when fewer than min_coverage of its
words are known or have a known gram of 3 characters or more, or when its 3-grams are unusual for the language: their mean log
frequency (by word, then over the words) lies under the training documents' median by more than a tolerance and MAX_DEVIATIONS of what so many words differ by chance. The tolerance is
what all but 1 - KEPT of the training documents need, scored without their own counts. Null or rare labels (under min_label documents) train nothing; all other labels are languages, however many. Every row is
judged by itself: repeated rows, null ids and other columns, whatever their names, are passed on.
An empty table gives an empty result; without labels there is no model and every document is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .text_kernel import Words, mix64, slices

LONGEST = 5
TRAIN_PER_LANGUAGE = 4000
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
MIN_LABEL = 5
MIN_POSTERIOR = 0.5
MIN_COVERAGE = 0.2
SMOOTHING = 0.5
MAX_DEVIATIONS = 5.0
KEPT = 0.999
USUAL = 3
_U = np.uint64


@dataclass
class Model:
    """languages; for each kind (0 words, n for n-grams) sorted hashes and their log frequencies by language.

    unseen: by language, the log frequency of an unseen 3-gram; usual: median and tolerance of the mean log
    frequency of 3-grams, and its variance from word to word.
    """

    languages: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    unseen: np.ndarray | None = None
    usual: np.ndarray | None = None


def word_grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words, padded with a space, and the index of each one's word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = len(points) - n + 1
    if m <= 0 or not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = points == 32
    ok = ~space[:m] if n == 1 else np.ones(m, bool)
    for j in range(1, n - 1):
        ok &= ~space[j : j + m]
    h = np.full(m, _U(n), np.uint64)
    for j in range(n):
        h = h * _U(0x100000001B3) + points[j : j + m]
    owner = np.cumsum(space)[:m] - 1
    # a gram that begins with the space before a word belongs to that word, as do those that begin inside it
    return mix64(h[ok]), owner[ok]


def _word_counts(languages: list[str]):
    def run(batches):
        for piece in slices(batches, "text"):
            label = pc.index_in(piece.column("lang"), pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
            w = Words(piece.column("text"))
            if not len(w):
                continue
            lang = np.repeat(label.astype(np.int64), w.counts)
            uniq, at, inv = np.unique(w.hash, return_index=True, return_inverse=True)
            counts = np.zeros((len(uniq), len(languages)), np.int64)
            np.add.at(counts, (inv, lang), 1)
            strings = [w.text(i) for i in at]
            kinds, hashes, tables = [np.zeros(len(uniq), np.int32)], [uniq], [counts]
            for n in range(1, LONGEST + 1):
                g, owner = word_grams(strings, n)
                key, gi = np.unique(g, return_inverse=True)
                t = np.zeros((len(key), len(languages)), np.int64)
                np.add.at(t, gi, counts[owner])
                kinds.append(np.full(len(key), n, np.int32))
                hashes.append(key)
                tables.append(t)
            table = np.concatenate(tables)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes).view(np.int64))] + [pa.array(table[:, j]) for j in range(len(languages))],
                names=["kind", "key"] + [f"n{j}" for j in range(len(languages))],
            )

    return run


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    train_per_language: int = TRAIN_PER_LANGUAGE,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
    min_label: int = MIN_LABEL,
) -> Model | None:
    docs, text_col, lang_col = common.numbered(docs, text_col, lang_col)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= min_label).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, train_per_language / sizes[k])))])
    drawn = rows.where(F.col("lang").isin(languages)).where(F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    columns = ", ".join(f"n{j} bigint" for j in range(len(languages)))
    counted = drawn.mapInArrow(_word_counts(languages), f"kind int, key bigint, {columns}")
    sums = [F.sum(f"n{j}").alias(f"n{j}") for j in range(len(languages))]
    total = sum((F.col(f"n{j}") for j in range(len(languages))), F.lit(0))
    w = Window.partitionBy("kind").orderBy(F.desc("total"), "key")
    top = counted.groupBy("kind", "key").agg(*sums).withColumn("total", total).withColumn("rank", F.row_number().over(w))
    found = top.where(F.col("rank") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams)).drop("total", "rank").toArrow()
    kind = found.column("kind").to_numpy()
    key = found.column("key").to_numpy().view(np.uint64)
    counts = np.column_stack([found.column(f"n{j}").to_numpy() for j in range(len(languages))]).astype(np.float64).reshape(-1, len(languages))
    keys, logs = {}, {}
    for k in range(LONGEST + 1):
        mine = np.flatnonzero(kind == k)
        mine = mine[np.argsort(key[mine])]
        c = counts[mine]
        keys[k] = key[mine]
        logs[k] = np.log((c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * max(1, len(mine))))
        if k == USUAL:
            unseen = np.log(SMOOTHING / (c.sum(axis=0) + SMOOTHING * max(1, len(mine))))
    model = Model(languages, keys, logs, unseen)
    model.usual = _usual(drawn, model)
    return model


def _held_out(held):
    """(lang, n, mean, variance) of the words' scores of each training document, by a model without that document."""

    def run(batches):
        model = held.value
        for piece in slices(batches, "text"):
            label = pc.index_in(piece.column("lang"), pa.array(model.languages, pa.string())).to_pylist()
            out = []
            for i, j in enumerate(label):
                w = Words(piece.column("text").slice(i, 1))
                if not len(w):
                    continue
                _, at, times = np.unique(w.hash, return_index=True, return_counts=True)
                g, owner = word_grams([w.text(x) for x in at], USUAL)
                key, gi = np.unique(g, return_inverse=True)
                own = np.bincount(gi, weights=times[owner])
                hit = _look_up(model.keys[USUAL], key)
                size = SMOOTHING / np.exp(model.unseen[j])
                count = np.where(hit >= 0, np.exp(model.logs[USUAL][hit, j]) * size - SMOOTHING - own, 0)
                score = np.log((np.maximum(count, 0) + SMOOTHING) / (size - own[hit >= 0].sum()))[gi]
                score = np.bincount(owner, weights=score) / np.bincount(owner)
                mean = np.average(score, weights=times)
                out.append((j, len(w), mean, np.average((score - mean) ** 2, weights=times)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out)], names=["lang", "n", "mean", "variance"])

    return run


def _usual(drawn: DataFrame, model: Model) -> np.ndarray:
    held = drawn.sparkSession.sparkContext.broadcast(model)
    found = drawn.mapInArrow(_held_out(held), "lang bigint, n bigint, mean double, variance double").toArrow()
    lang, n, mean, variance = (found.column(c).to_numpy() for c in ("lang", "n", "mean", "variance"))
    out = np.tile([-np.inf, 0.0, 0.0], (len(model.languages), 1))
    for j in range(len(model.languages)):
        mine = lang == j
        if mine.any():
            middle, word = np.median(mean[mine]), np.median(variance[mine])
            spread = 1.4826 * np.median(np.abs(mean[mine] - middle))
            needed = np.quantile(middle - mean[mine] - MAX_DEVIATIONS * np.sqrt(word / n[mine]), KEPT)
            out[j] = middle, max(needed, MAX_DEVIATIONS * spread), word
    return out


def usualness(model: Model, words: Words) -> np.ndarray:
    """For each word the mean log frequency of its 3-grams, by language."""
    _, at, inv = np.unique(words.hash, return_index=True, return_inverse=True)
    g, owner = word_grams([words.text(i) for i in at], USUAL)
    hit = _look_up(model.keys[USUAL], g)
    count = np.maximum(np.bincount(owner, minlength=len(at)), 1)
    known = hit >= 0
    out = [np.bincount(owner, weights=np.where(known, model.logs[USUAL][hit, j] if len(model.logs[USUAL]) else 0, model.unseen[j]), minlength=len(at)) / count for j in range(len(model.languages))]
    return np.column_stack(out)[inv]


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def score_words(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word its scores by language, and the level that gave them: 0 a known word, n its n-grams, -1 nothing."""
    uniq, at, inv = np.unique(words.hash, return_index=True, return_inverse=True)
    found = _look_up(model.keys[0], uniq)
    scores = np.zeros((len(uniq), len(model.languages)))
    level = np.where(found >= 0, 0, -1)
    scores[found >= 0] = model.logs[0][found[found >= 0]]
    open_ = np.flatnonzero(found < 0)
    strings = [words.text(at[i]) for i in open_]
    for n in range(LONGEST, 0, -1):
        if not len(open_):
            break
        g, owner = word_grams(strings, n)
        hit = _look_up(model.keys[n], g)
        good = hit >= 0
        count = np.bincount(owner[good], minlength=len(open_))
        for j in range(len(model.languages)):
            s = np.bincount(owner[good], weights=model.logs[n][hit[good], j], minlength=len(open_))
            scores[open_[count > 0], j] = s[count > 0] / count[count > 0]
        level[open_[count > 0]] = n
        left = np.flatnonzero(count == 0)
        open_, strings = open_[left], [strings[i] for i in left]
    return scores[inv], level[inv]


def judge(model: Model | None, column: pa.Array, min_posterior: float, min_coverage: float) -> dict[str, pa.Array]:
    n = len(column)
    best, usual = np.full(n, -1), np.ones(n, bool)
    posterior, coverage = np.zeros(n), np.zeros(n)
    words = Words(column)
    if model is not None and len(words):
        scores, level = score_words(model, words)
        have = np.flatnonzero(words.counts > 0)
        sums = np.add.reduceat(scores, words.first[have], axis=0)
        scored = np.add.reduceat((level >= 0).astype(np.int64), words.first[have])
        top = sums.argmax(axis=1)
        best[have] = np.where(scored > 0, top, -1)
        posterior[have] = np.where(scored > 0, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0)
        coverage[have] = np.add.reduceat(((level == 0) | (level >= 3)).astype(np.int64), words.first[have]) / words.counts[have]
        if model.usual is not None:
            mean = np.add.reduceat(usualness(model, words), words.first[have], axis=0)[np.arange(len(have)), top] / words.counts[have]
            middle, tolerance, word = model.usual[top].T
            usual[have] = mean >= middle - tolerance - MAX_DEVIATIONS * np.sqrt(word / words.counts[have])
    names = pa.array(model.languages if model else [], pa.string())
    accepted = (best >= 0) & (posterior >= min_posterior) & (coverage >= min_coverage) & usual
    return {
        "predicted_lang": names.take(pa.array(best, pa.int64(), mask=best < 0)),
        "posterior": pa.array(posterior),
        "coverage": pa.array(coverage),
        "n_words": pa.array(words.counts.astype(np.int64)),
        "accepted": pa.array(accepted),
    }


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = MIN_POSTERIOR, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, predicted_lang, posterior, coverage, n_words, accepted) of every row of docs."""
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), **judge(held.value, piece.column("text"), min_posterior, min_coverage)})

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, predicted_lang string, posterior double, coverage double, n_words bigint, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", min_posterior: float = MIN_POSTERIOR, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of docs whose language is accepted, with all their columns as they are."""
    names = docs.columns
    docs, text_col = common.numbered(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for piece in slices(batches, text_col):
            yield piece.filter(judge(held.value, piece.column(at), min_posterior, min_coverage)["accepted"])

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model fitted on the table's own labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))

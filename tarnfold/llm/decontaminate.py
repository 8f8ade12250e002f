"""Benchmark decontamination with an FM-index over each training shard.

1. Benchmark items become phrases: every run of phrase_words words; an item of fewer words, but at least
   min_item_words, is one phrase as a whole.
2. A task cuts its documents into shards of about shard_bytes, reduces each to the benchmark's vocabulary (a run of other
   words, and the end of a document, is one separator), sorts its suffixes, and keeps the Burrows-Wheeler
   transform in a wavelet matrix.
3. Backward search runs all phrases at once through wavelet ranks; an interval that becomes empty drops out.
4. The rows of what is left are located by walking to the next sampled suffix position.
5. Spans of a document that touch or overlap are merged, and drop_leaks cuts them out.

One scan, no shuffle. What is broadcast is the benchmark, whose size is checked, never anything of the corpus.

Defined results: words are those of text_kernel, compared without case. Null and empty texts hold nothing. An item without text or with fewer than
min_item_words words matches nothing. Items that repeat are all named. Every row is judged by itself, so repeated rows and ids,
null ids and other columns of any name are passed on. Without documents or without items nothing is found.
A text is searched whole, of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text_kernel import WORD_SQL, Words, slices

PHRASE_WORDS = 8
MIN_ITEM_WORDS = 5
SHARD_BYTES = 6 << 20
SAMPLE_EVERY = 8
MAX_BENCHMARK_BYTES = 256 << 20
_END, _BREAK, _FIRST = 0, 1, 2


@dataclass
class Phrases:
    """vocab: sorted word hashes; symbol of a word = _FIRST + its index. by_length: for each length the phrases' symbols and a list of item numbers each."""

    vocab: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    item_ids: list

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.full(len(hashes), _BREAK, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + _FIRST, _BREAK)


def phrases_of(items: pa.Table, phrase_words: int = PHRASE_WORDS, min_item_words: int = MIN_ITEM_WORDS) -> Phrases:
    """items: columns item_id and text."""
    w = Words(items.column("text").combine_chunks())
    vocab = np.unique(w.hash)
    symbol = np.searchsorted(vocab, w.hash) + _FIRST
    rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, n in enumerate(w.counts.tolist()):
        if n < min(min_item_words, phrase_words):
            continue
        size = min(n, phrase_words)
        own = np.lib.stride_tricks.sliding_window_view(symbol[w.first[i] : w.first[i + 1]], size)
        rows.setdefault(size, []).append((own, np.full(len(own), i)))
    by_length = {}
    for size, parts in rows.items():
        uniq, inv = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([inv.ravel(), np.concatenate([o for _, o in parts])]), axis=0)
        by_length[size] = (uniq, np.searchsorted(pairs[:, 0], np.arange(len(uniq) + 1)), pairs[:, 1])
    return Phrases(vocab, by_length, items.column("item_id").to_pylist())


def suffix_array(t: np.ndarray, bits: int) -> np.ndarray:
    """Ranks by packed first symbols, then doubling on the suffixes that are still tied."""
    n, width = len(t), max(1, 62 // bits)
    padded = np.concatenate([t.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    ranked = key[sa]
    start = np.ones(n, bool)
    start[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(start, slots, 0))
    alone = start & np.append(start[1:], True)
    tied, h = np.flatnonzero(~alone), width
    while len(tied):
        pos = sa[tied]
        first, after = rank[pos], pos + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, first))
        pos, first, second = pos[order], first[order], second[order]
        sa[tied] = pos
        start = np.ones(len(tied), bool)
        start[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[pos] = tied[np.maximum.accumulate(np.where(start, np.arange(len(tied)), 0))]
        alone = start & np.append(start[1:], True)
        tied, h = tied[~alone], h * 2
    return sa


class FMIndex:
    """Counts and places of phrases in a sequence of symbols that ends with a single _END."""

    def __init__(self, t: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        self.bits = max(1, int(sigma - 1).bit_length())
        sa = suffix_array(t, self.bits)
        bwt = t[sa - 1]
        self.n = len(t)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            cum = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=cum[1:])
            self.ones.append(cum)
            self.zeros.append(self.n - int(cum[-1]))
            hot = bit.astype(bool)
            level = np.concatenate([level[~hot], level[hot]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))
        sampled = sa % every == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = sa[sampled]

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (cum, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            up = cum[i].astype(np.int64)
            i = np.where(one, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs before row i of the transform."""
        return self._descend(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for cum, zeros in zip(self.ones, self.zeros):
            up = cum[i].astype(np.int64)
            one = cum[i + 1] > up
            i = np.where(one, zeros + up, i - up)
            c = (c << 1) | one
        return c

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases that occur, and the first and last + 1 row of each."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low, high = self.below[c] + self.rank(c, low), self.below[c] + self.rank(c, high)
            ok = high > low
            live, low, high = live[ok], low[ok], high[ok]
            if not len(live):
                break
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each row, from the next sampled one before it."""
        out, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            known = self.sample_rank[rows + 1] > self.sample_rank[rows]
            out[at[known]] = self.samples[self.sample_rank[rows[known]]] + steps
            rows, at = rows[~known], at[~known]
            if len(rows):
                c = self.access(rows)
                rows = self.below[c] + self.rank(c, rows)
            steps += 1
        return out


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [start, end) of the same document that touch or overlap become one; sorted by document and start."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    # one running maximum over all documents: each is moved beyond all before it
    room = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * room + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * room + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - doc[first] * room


def _shards(batches, text_col: str, limit: int):
    held, size = [], 0
    for piece in slices(batches, text_col):
        held.append(piece)
        size += piece.column(text_col).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_in(pieces: list[pa.RecordBatch], text_col: str, p: Phrases, every: int = SAMPLE_EVERY):
    """For each piece: its Words, merged spans (document, first word, last word + 1; words count from the piece's start) and hits (document, item)."""
    words = [Words(b.column(text_col)) for b in pieces]
    parts, places, bases, base = [], [], [], 0
    for w in words:
        s = p.symbols(w.hash)
        # a separator in front of each document's first word, then runs of separators become one
        full = np.insert(s, w.first[:-1], _BREAK)
        place = np.insert(np.arange(len(s)) + base, w.first[:-1], -1)
        keep = np.ones(len(full), bool)
        keep[1:] = (full[1:] != _BREAK) | (full[:-1] != _BREAK)
        parts.append(full[keep])
        places.append(np.where(full == _BREAK, -1, place)[keep])
        bases.append(base)
        base += len(s)
    t = np.concatenate([*parts, [_BREAK, _END]])
    place = np.concatenate([*places, [-1, -1]])
    first_word, n_words, who = [], [], []
    if p.by_length and (place >= 0).any():
        index = FMIndex(t, len(p.vocab) + _FIRST, every)
        for size, (phrases, _, _) in p.by_length.items():
            live, low, high = index.search(phrases)
            count = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            first_word.append(place[index.locate(rows)])
            n_words.append(np.full(len(rows), size))
            who.append(np.repeat(live, count))
    for k, w in enumerate(words):
        docs, starts, ends, hits = [], [], [], []
        for f, n, number, (_, at, items) in zip(first_word, n_words, who, p.by_length.values()):
            mine = (f >= bases[k]) & (f < bases[k] + len(w))
            start = f[mine] - bases[k]
            doc = np.searchsorted(w.first, start, "right") - 1
            docs.append(doc)
            starts.append(start)
            ends.append(start + n[mine])
            many = at[number[mine] + 1] - at[number[mine]]
            which = np.repeat(at[number[mine]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            hits.append(np.column_stack([np.repeat(doc, many), items[which]]))
        none = np.zeros(0, np.int64)
        d, s, e = merge_spans(*(np.concatenate(x) if x else none for x in (docs, starts, ends)))
        yield w, d, s, e, np.unique(np.concatenate(hits), axis=0) if hits else np.zeros((0, 2), np.int64)


def _phrases(benchmark: DataFrame, phrase_words: int, min_item_words: int) -> Phrases:
    common.need(benchmark, "item_id", "text")
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; {MAX_BENCHMARK_BYTES} fit into each task's memory: search it in parts")
    return phrases_of(items.orderBy("item_id", "text").toArrow(), phrase_words, min_item_words)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrase_words: int = PHRASE_WORDS,
    min_item_words: int = MIN_ITEM_WORDS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, items, span_starts, span_ends, removed_words) of every document with a benchmark phrase.

    items: ids of the items found, ascending. Spans are word numbers from 0, the end excluded.
    """
    docs, id_col, text_col = common.numbered(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(_phrases(benchmark, phrase_words, min_item_words))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = dict(narrow.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]

    def run(batches):
        p = held.value
        for pieces in _shards(batches, "text", shard_bytes):
            for piece, (w, d, s, e, hits) in zip(pieces, find_in(pieces, "text", p)):
                if not len(d):
                    continue
                own, at = np.unique(d, return_index=True)
                cuts = np.append(at, len(d))
                ids = piece.column("doc_id").take(pa.array(own))
                from_, to = s - w.first[d], e - w.first[d]
                items = [sorted({p.item_ids[i] for i in hits[hits[:, 0] == k, 1] if p.item_ids[i] is not None}) for k in own]
                lists = lambda x: [x[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids,
                        "items": items,
                        "span_starts": lists(from_),
                        "span_ends": lists(to),
                        "removed_words": np.add.reduceat(to - from_, at),
                    }
                )

    return narrow.mapInArrow(run, f"doc_id {id_type}, items array<{item_type}>, span_starts array<bigint>, span_ends array<bigint>, removed_words bigint")


def cut_text(text: bytes, w: Words, doc: int, starts, ends) -> bytes:
    """The text without the spans: from a span's first word up to the next word that stays."""
    base, out, at = int(w.offsets[doc]), [], 0
    for s, e in zip(starts, ends):
        out.append(text[at : int(w.starts[s]) - base])
        at = int(w.starts[e]) - base if e < w.first[doc + 1] else len(text)
    return b"".join([*out, text[at:]])


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    length_col: str = "n_chars",
    phrase_words: int = PHRASE_WORDS,
    min_item_words: int = MIN_ITEM_WORDS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """docs with the spans cut out of their texts, and length_col, where there is one, counted anew for these.

    A document of which nothing but spans was left goes. All other documents stay as they are.
    """
    names = docs.columns
    length_at = names.index(length_col) if dict(docs.dtypes).get(length_col) in ("int", "bigint") else None
    docs, text_col = common.numbered(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(_phrases(benchmark, phrase_words, min_item_words))
    at = docs.columns.index(text_col)

    def run(batches):
        p = held.value
        for pieces in _shards(batches, text_col, shard_bytes):
            for piece, (w, d, s, e, _) in zip(pieces, find_in(pieces, text_col, p)):
                if not len(d):
                    yield piece
                    continue
                own, first = np.unique(d, return_index=True)
                cuts = np.append(first, len(d))
                whole = np.ones(piece.num_rows, bool)
                new_text, new_length = {}, {}
                for k, a, b in zip(own.tolist(), cuts, cuts[1:]):
                    if (e[a:b] - s[a:b]).sum() == w.counts[k]:
                        whole[k] = False
                        continue
                    text = cut_text(piece.column(at)[k].as_py().encode(), w, k, s[a:b], e[a:b]).decode()
                    new_text[k], new_length[k] = text, len(text)
                changed = pa.array(np.isin(np.arange(piece.num_rows), list(new_text)))
                for column, values in ((at, new_text), (length_at, new_length)):
                    if column is not None and values:
                        field = piece.schema.field(column)
                        piece = piece.set_column(column, field, pc.replace_with_mask(piece.column(column), changed, pa.array([values[k] for k in sorted(values)], field.type)))
                yield piece.filter(pa.array(whole))

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')"
ORACLE_SQL = f"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{WORD_SQL}') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, regexp_extract_all({_FOLD}, '{WORD_SQL}') AS w FROM benchmark WHERE text IS NOT NULL),
item_sizes AS (SELECT item_id, w, least(len(w), {PHRASE_WORDS}) AS size FROM item_words WHERE len(w) >= {MIN_ITEM_WORDS}),
phrases AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM item_sizes)
),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc_words CROSS JOIN (SELECT DISTINCT size FROM item_sizes) WHERE len(w) >= size)
),
hits AS (SELECT doc_id, item_id, i - 1 AS s, i - 1 + size AS e FROM grams JOIN phrases USING (size, phrase)),
reach AS (
  SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits
),
runs AS (
  SELECT doc_id, s, e, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM reach
),
spans AS (SELECT doc_id, run, min(s) AS s, max(e) AS e FROM runs GROUP BY doc_id, run)
SELECT doc_id, items, span_starts, span_ends, removed_words FROM (
  SELECT doc_id, list(s ORDER BY s) AS span_starts, list(e ORDER BY s) AS span_ends, CAST(sum(e - s) AS BIGINT) AS removed_words
  FROM spans GROUP BY doc_id
) JOIN (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id) USING (doc_id)
"""

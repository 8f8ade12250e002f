import random

import awkward
import numpy as np
import pyarrow as pa

from tarnfold.llm import decontaminate as D


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(texts, items, n=D.PHRASE_WORDS, least=D.MIN_ITEM_WORDS):
    """{doc index: (items, merged word spans)}"""

    def words(t):
        w = D.Words(pa.array([t]))
        return [w.text(i) for i in range(len(w))]

    out = {}
    for k, t in enumerate(texts):
        w = words(t or "")
        spans, found = [], set()
        for item_id, item in items:
            x = words(item or "")
            if len(x) < least:
                continue
            size = min(n, len(x))
            grams = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    spans.append([i, i + size])
                    found.add(item_id)
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        if merged:
            out[k] = (sorted(found), merged)
    return out


def cases():
    r = random.Random(4)
    items = [(i, awkward.prose(i + 500, r.randint(3, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "too short"), (7, awkward.prose(507, 9))]
    texts = [awkward.prose(i, r.randint(0, 200)) for i in range(120)]
    for k in range(0, 120, 3):
        item = r.choice(items)[1] or ""
        w = texts[k].split()
        at = r.randint(0, len(w))
        texts[k] = " ".join([*w[:at], item.upper() if k % 2 else item, *w[at:], *(item.split() if k % 4 == 0 else [])])
    return texts + [None, "", "…", items[0][1], (items[0][1] + ", ") * 50], items


def test_against_brute_force(spark):
    texts, items = cases()
    df = awkward.frame(spark, [awkward.row(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: (r["items"], [list(x) for x in zip(r.span_starts, r.span_ends)]) for r in D.find_leaks(df, bench(spark, items), shard_bytes=4000).collect()}
    assert got == brute(texts, items)


def test_cut(spark):
    texts, items = cases()
    df = awkward.frame(spark, [awkward.row(i, t) for i, t in enumerate(texts)])
    kept = D.drop_leaks(df, bench(spark, items))
    assert kept.schema == df.schema
    rows = {r.doc_id: r for r in kept.collect()}
    found = brute(texts, items)
    for i, t in enumerate(texts):
        if i not in found:
            assert rows[i].text == t
        elif sum(e - s for s, e in found[i][1]) == len(D.Words(pa.array([t]))):
            assert i not in rows
        else:
            assert rows[i].n_chars == len(rows[i].text) < len(t)
            words = t.split()
            left = [w for k, w in enumerate(words) if not any(s <= k < e for s, e in found[i][1])]
            assert rows[i].text.split() == left


def test_suffix_array_and_index():
    r = np.random.default_rng(3)
    for n, sigma in ((1, 3), (50, 3), (400, 4), (400, 30), (900, 2)):
        t = np.append(r.integers(1, max(2, sigma), n), 0)
        if n == 900:
            t[:-1] = 1
        sa = D.suffix_array(t, max(1, int(sigma - 1).bit_length()))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        index = D.FMIndex(t, sigma, every=5)
        for _ in range(30):
            k = int(r.integers(1, 5))
            p = r.integers(1, max(2, sigma), k)
            live, low, high = index.search(p[None, :])
            want = [i for i in range(len(t) - k) if (t[i : i + k] == p).all()]
            assert (int(high[0] - low[0]) if len(live) else 0) == len(want)
            if len(live):
                assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_awkward_and_empty(spark):
    items = bench(spark, [(1, awkward.prose(1, 120)), (2, "one"), (None, awkward.prose(2, 90))])
    got = {r.doc_id for r in D.find_leaks(awkward.frame(spark), items).collect()}
    assert {1, 2, None, 12, 13} <= got and 16 not in got
    assert D.drop_leaks(awkward.frame(spark), items).count() == awkward.frame(spark).count() - 5
    for d, b in ((awkward.empty(spark), items), (awkward.frame(spark), bench(spark, []))):
        assert D.find_leaks(d, b).count() == 0
        assert D.drop_leaks(d, b).count() == d.count()

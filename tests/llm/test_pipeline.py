import os
import random

import awkward
import corpus_pipeline as P
import pyarrow as pa
from test_jaccard_join import brute, groups_of
from test_related_packing import lossless, words

from tarnfold.llm.text_kernel import Words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(seed: int):
    """Documents in two made languages, with gibberish, exact and near copies, benchmark passages, awkward and extra rows."""
    r = random.Random(seed)
    vocabulary = {x: ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(600)] for x, parts in (("xx", ["ba", "lo", "mi", "ter"]), ("yy", ["sch", "ung", "ein", "hof"]))}
    prose = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    items = [(i, prose("xx", 20)) for i in range(4)] + [(9, None), (8, "")]
    rows = []
    for i in range(160):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, prose(lang, r.randint(30, 90)), lang))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 40, 3)]
    rows += [(300 + i, rows[i][1] + " " + prose(rows[i][2], 2), rows[i][2]) for i in range(0, 60, 5)]
    rows += [(400 + i, prose("xx", 15) + " " + items[i % 4][1] + " " + prose("xx", 15), "xx") for i in range(6)] + [(410, items[0][1], "xx")]
    rows += [(500 + i, " ".join("".join(r.choice("qwxzjkvp0123456789") for _ in range(9)) for _ in range(40)), None) for i in range(5)]
    rows += [(600, None, None), (601, "", "xx"), (602, "  \n ", "yy"), (None, rows[3][1], "xx"), (7, rows[7][1], "xx"), (603, prose("yy", 20_000), "yy"), (604, "% % %", "xx")]
    return [(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows], items


def plain_words(text):
    w = Words(pa.array([text], pa.string()))
    return [w.text(i) for i in range(len(w))]


def test_stages_against_brute_force(spark, tmp_path):
    data, items = texts(1)
    folder = str(tmp_path / "sf")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        assert n == 4 or out.schema == docs.schema
        out.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        seen.append([tuple(x) for x in docs.collect()] if n < 4 else docs.collect())
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    # language ID: what has words and isn't gibberish stays, as it was
    gone = {500, 501, 502, 503, 504, 600, 601, 602, 604}
    assert sorted(seen[0], key=key) == sorted((x for x in data if x[0] not in gone), key=key)
    # exact dedup: of equal texts the smallest id, null ids last
    first = {}
    for x in sorted(seen[0], key=key):
        first.setdefault(x[1], x)
    assert sorted(seen[1], key=key) == sorted(first.values(), key=key)
    # near copies: one of each group
    group = groups_of(brute(seen[1], 0.5))
    assert len(group) > 10 and sorted(seen[2], key=key) == sorted((x for x in seen[1] if group.get(x[0], x[0]) == x[0]), key=key)
    # benchmark: no run of eight words of an item is left, and nothing else has changed
    phrases = {tuple(w[i : i + 8]) for _, t in items if t for w in [plain_words(t)] for i in range(len(w) - 7)}
    want = {}
    for x in seen[2]:
        w = plain_words(x[1])
        hit = set()
        for i in range(len(w) - 7):
            if tuple(w[i : i + 8]) in phrases:
                hit |= set(range(i, i + 8))
        if len(hit) < len(w):
            want[x[0]] = [y for i, y in enumerate(w) if i not in hit]
    assert {x[0]: plain_words(x[1]) for x in seen[3]} == want and all(x[4] == len(x[1]) for x in seen[3])
    # packing: every word of every document that is left, once
    lossless([((x[0],), words(x[1])) for x in seen[3]], seen[4], 4096)
    # run() is the stages one after another
    run = P.run(spark, folder)
    assert sorted(i for w in run.collect() for i in w.doc_ids) == sorted(i for w in seen[4] for i in w.doc_ids)


def test_awkward_and_empty(spark, tmp_path):
    """Extra columns with clashing names pass through the first four stages; empty tables give empty ones."""
    spark.createDataFrame([(1, awkward.prose(5, 300)[:120])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (awkward.frame(spark), awkward.empty(spark)):
        n = docs.count()
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or (out.count() <= n and out.schema == docs.schema), name
            assert n or out.count() == 0


def test_it_is_named_in_the_entry_point():
    assert [s for s, _ in P.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert os.path.exists(P.__file__) and P.ORACLE_SQL is None

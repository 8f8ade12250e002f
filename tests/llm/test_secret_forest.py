import os
import random
import re
import subprocess
import sys
from pathlib import Path

import awkward
import numpy as np
import pyarrow as pa

from tarnfold.llm import secret_forest as S

ROOT = str(Path(__file__).resolve().parents[2])


def lexicon(spark):
    docs = awkward.frame(spark, [awkward.row(i, awkward.prose(i, 200)) for i in range(40)])
    counted = S.dictionary(docs)
    return counted, S.lexicon_of(counted)


def test_dictionary_counts_documents(spark):
    rows = [awkward.row(1, "alpha alpha beta4 gamma abc"), awkward.row(2, "Alpha gamma"), awkward.row(3, "alpha delta"), awkward.row(4, None), awkward.row(5, "")]
    assert S.dictionary(awkward.frame(spark, rows)) == {"alpha": 3, "gamma": 2, "delta": 1}
    assert S.dictionary(awkward.frame(spark, rows), max_words=2) == {"alpha": 3, "gamma": 2}
    assert S.dictionary(awkward.empty(spark)) == {}


def test_held_out_accuracy(spark):
    counted, lex = lexicon(spark)
    forest = S.fit(S.labelled_findings(list(counted), 3000), lex)
    held = S.labelled_findings(list(counted), 1000, seed=77)
    vote = forest.vote(np.array([S.features(*h[:4], lex) for h in held]))
    y = np.array([h[4] for h in held])
    assert ((vote >= 0.5) == y).mean() > 0.95


def test_forest_on_a_rule():
    r = np.random.default_rng(0)
    x = r.random((800, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = S.grow(x[:600], y[:600], trees=30, each=3)
    assert ((f.vote(x[600:]) >= 0.5) == y[600:]).mean() > 0.93
    assert S.grow(x[:0], y[:0]).vote(x[:3]).tolist() == [0, 0, 0]


def test_candidates_by_plain_python():
    texts = ["key = 0123456789abcdef01234567.", None, "", "plain words thatareverylongindeedbutletters", "a@mail9.example.com", "aB1_" * 10 + " --x--0123456789abcdef-- " + "-----BEGIN RSA PRIVATE KEY-----", "1234567890123456", "é" + "a1" * 12 + "é", "CamelCaseCanBeMixedIn", "z9" * 40000]
    doc, start, end = S.candidates(pa.array(texts))
    raw, offsets = S.buffers(pa.array(texts))
    got = [(int(d), raw[s:e].tobytes().decode()) for d, s, e in zip(doc, start, end)]
    assert (0, "0123456789abcdef01234567") in got and (5, "aB1_" * 10) in got
    assert (5, "x--0123456789abcdef") in got and (5, "-----BEGIN RSA PRIVATE KEY-----") in got
    assert (7, "a1" * 12) in got and (8, "CamelCaseCanBeMixedIn") in got and (9, "z9" * 40000) in got
    assert not {1, 2, 3, 6} & {d for d, _ in got}


def plain_candidates(text: str) -> set:
    """The rule of candidates in plain Python, over one text."""
    data, out = text.encode(), set()
    named = []
    for m in S._NAMED.finditer(data):
        named.append(next(m.span(g) for g in (1, 2, 3) if m.group(g) is not None))
    for m in re.finditer(rb"[A-Za-z0-9+/_\-=.]{16,}", data):
        a, b = m.span()
        for sign in (b".", b"-", b"/", b"+", b"_"):
            while b - a > 1 and data[a : a + 1] == sign:
                a += 1
        while b - a > 1 and data[b - 1 : b] in (b".", b"-"):
            b -= 1
        v = data[a:b]
        digit, low = sum(48 <= c < 58 for c in v), sum(97 <= c < 123 for c in v)
        up = sum(65 <= c < 91 for c in v)
        mixed = low > 2 and up - (65 <= v[0] < 91) > 2
        if b - a >= 16 and (digit and low + up or mixed) and not any(x < b and y > a for x, y in named):
            out.add((a, b))
    return out | set(named) | {m.span() for m in S._HEADER.finditer(data)}


def test_candidates_against_plain_python():
    r = random.Random(9)
    pieces = ["password: ", "token=", 'api_key = "', "'", '"', " ", "\n", "abc", "Zq8xK2", "0123456789abcdef", "..", "--", "é", "hunter2!", "correct-horse-battery", "=", "/+_", "-----BEGIN EC PRIVATE KEY-----", "AbCdEfGhIjKlMnOpQr"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(400)]
    doc, start, end = S.candidates(pa.array(texts))
    _, offsets = S.buffers(pa.array(texts))
    got = {(int(d), int(s - offsets[d]), int(e - offsets[d])) for d, s, e in zip(doc, start, end)}
    assert got == {(i, a, b) for i, t in enumerate(texts) for a, b in plain_candidates(t)}


def test_votes_against_plain_python(spark):
    """Each tree walked node by node gives the forest's vote; no leaf is empty, and five hash seeds give the same votes."""
    counted, lex = lexicon(spark)
    found = S.labelled_findings(list(counted), 400)
    forest = S.fit(found, lex, trees=8)
    x = np.array([S.features(*f[:4], lex) for f in S.labelled_findings(list(counted), 100, seed=5)])
    for row, vote in zip(x, forest.vote(x)):
        total = 0.0
        for feature, cut, left, share in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + int(row[feature[at]] > cut[at])
            assert 0 <= share[at] <= 1
            total += share[at]
        assert vote == total / len(forest.trees)
    code = "import numpy as np; from tarnfold.llm import secret_forest as S; lex = S.lexicon_of({'alpha': 3, 'gamma': 2}); f = S.fit(S.labelled_findings(['alpha', 'gamma'], 300), lex, trees=6); print(repr(f.vote(np.array([S.features(*x[:4], lex) for x in S.labelled_findings(['alpha', 'gamma'], 200, seed=3)])).tolist()))"
    said = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": str(k)}, cwd=ROOT, capture_output=True, text=True, check=True).stdout for k in range(5)}
    assert len(said) == 1


def test_short_passwords_are_found(spark):
    counted, lex = lexicon(spark)
    forest = S.fit(S.labelled_findings(list(counted)), lex)
    rows = [awkward.row(1, "the of password: kT9#pw!xQ2 and"), awkward.row(2, "in DB_PASSWORD=Summer!2041$ab in"), awkward.row(3, "the token=<your-token> of"), awkward.row(4, "passwords are long: the of and")]
    got = {r.doc_id: r.is_secret for r in S.scan(awkward.frame(spark, rows), lex, forest).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_scan_finds_keys_and_leaves_digests(spark):
    counted, lex = lexicon(spark)
    forest = S.fit(S.labelled_findings(list(counted)), lex)
    key, digest = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "9bc34549d565d9505b287de0cd20ac77be1d3f2c"
    rows = [awkward.row(1, f'the of token = "{key}" and in'), awkward.row(2, f"the sha256 {digest} of and"), awkward.row(3, f'ünï token = "{key}"'), *awkward.rows()]
    out = S.scan(awkward.frame(spark, rows), lex, forest).collect()
    got = {(r.doc_id, r.first_byte, r.is_secret) for r in out if r.n_bytes == 40}
    assert got == {(1, 16, True), (2, 11, False), (3, 15, True)}
    assert S.scan(awkward.empty(spark), lex, forest).count() == 0
    assert S.fit([], lex).vote(np.zeros((1, 22))).tolist() == [0]

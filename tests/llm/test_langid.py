import awkward
import numpy as np
import pyarrow as pa
import random

from tarnfold.llm import langid as L
from tarnfold.llm.text_kernel import Words, word_hash

SOUNDS = {"aa": "ka lo mi ru ta no".split(), "bb": "sch ent ung ver ber ich".split(), "cc": "eau oui que ment tion pas".split()}


def text(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def docs(spark, per=40):
    rows = [awkward.row(i * 3 + k, text(lang, i), lang) for i in range(per) for k, lang in enumerate(SOUNDS)]
    return awkward.frame(spark, rows)


def test_held_out_accuracy(spark):
    model = L.fit(docs(spark))
    assert model.languages == sorted(SOUNDS)
    new = awkward.frame(spark, [awkward.row(k, text(lang, 1000 + k, 12), lang) for k, lang in enumerate(list(SOUNDS) * 20)])
    got = {r.doc_id: r for r in L.identify(new, model).collect()}
    want = {k: lang for k, lang in enumerate(list(SOUNDS) * 20)}
    assert sum(got[k].predicted_lang == v and got[k].accepted for k, v in want.items()) >= 58


def test_scores_against_plain_python(spark):
    """Word first, then the longest n-gram that any of its grams knows."""
    model = L.fit(docs(spark))
    column = pa.array([text("aa", 5, 5) + " schunk zzz que", text("cc", 77, 9)])
    w = Words(column)
    scores, level = L.score_words(model, w)
    for i in range(len(w)):
        word = w.text(i)
        h = word_hash([word])[0]
        at = np.flatnonzero(model.keys[0] == h)
        if len(at):
            assert level[i] == 0 and np.allclose(scores[i], model.logs[0][at[0]])
            continue
        for n in range(L.LONGEST, 0, -1):
            g, _ = L.word_grams([word], n)
            hits = [int(np.flatnonzero(model.keys[n] == x)[0]) for x in g if (model.keys[n] == x).any()]
            if hits:
                assert level[i] == n and np.allclose(scores[i], model.logs[n][hits].mean(axis=0))
                break
        else:
            assert level[i] == -1 and not scores[i].any()


def test_awkward_rows(spark):
    df = awkward.frame(spark)
    model = L.fit(docs(spark))
    rows = L.identify(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.n_words == 0:
            assert r.predicted_lang is None and not r.accepted
    kept = L.keep_identified(df, model)
    assert kept.schema == df.schema and kept.count() == sum(r.accepted for r in rows)


def test_no_labels_and_empty(spark):
    assert L.fit(awkward.empty(spark)) is None
    assert {r.accepted for r in L.identify(awkward.frame(spark), None).collect()} == {False}
    assert L.identify(awkward.empty(spark), None).count() == 0
    assert L.keep_identified(awkward.empty(spark), L.fit(docs(spark))).count() == 0


POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
ENGLISH = "the people of this town have been working with their friends for many years and they know that there is nothing better than to be free in all that one does when others are not".split()


def test_texts_of_no_trained_language_are_rejected(spark):
    """Gibberish and an untrained language go, clean documents that trained nothing stay."""
    r = random.Random(6)
    spanish = "los hombres de esta ciudad han trabajado con sus amigos durante muchos años y saben que nada es mejor que ser libre en todo lo que uno hace cuando otros no lo son".split()
    prose = lambda words, n=60: " ".join(r.choice(words) for _ in range(n))
    model = L.fit(awkward.frame(spark, [awkward.row(2 * i + k, prose(words), lang) for i in range(60) for k, (words, lang) in enumerate([(ENGLISH, "en"), (spanish, "es")])]))
    letters = lambda alphabet: " ".join("".join(r.choice(alphabet) for _ in range(r.randint(3, 9))) for _ in range(60))
    bad = [letters("abcdefghijklmnopqrstuvwxyz"), letters("0123456789abcdef"), POLISH, letters("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")]
    good = [prose(words, n) for words in (ENGLISH, spanish) for n in (5, 20, 60, 300)]
    got = {x.doc_id: x.accepted for x in L.identify(awkward.frame(spark, [awkward.row(i, t) for i, t in enumerate(bad + good)]), model).collect()}
    assert [got[i] for i in range(len(bad))] == [False] * len(bad)
    assert [got[len(bad) + i] for i in range(len(good))] == [True] * len(good)

import random

import awkward
import numpy as np
import pytest

from tarnfold.llm import site_quality as Q


def docs(n=400, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = awkward.prose(i, 80) if good else " ".join(w.upper() + "!!" for w in awkward.prose(i, 30).split()) + " ### $$$"
        rows.append(awkward.row(i, text, r.choice(["en", "fr"]), f"s{i % 7}"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = docs()
    lab = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    df = awkward.frame(spark, rows)
    out = {r.doc_id: r for r in Q.judge(df, Q.fit(df, lab)).collect()}
    assert sum(out[i].keep == bool(q) for i, q, _ in labels[200:]) >= 195


def test_posteriors_by_plain_python(spark):
    rows, labels = docs(120, 3)
    rows += [awkward.row(500, awkward.prose(9, 30), None, None), awkward.row(None, "", "xx", "s1"), awkward.row(501, None, None, "s2")]
    df = awkward.frame(spark, rows)
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = Q.judge(df, model).collect()
    assert len(out) == len(rows)
    site = {(r[0], r[1]): (r[3], r[2]) for r in rows}
    key = {r[0]: (r[3], r[2]) for r in rows}
    p = np.array([r.evidence for r in out])
    host = np.array([str(key[r.doc_id][0]) for r in out])
    path = np.array([str(key[r.doc_id]) for r in out])
    n, mu = len(p), p.mean()

    def ss(groups):
        return sum(p[groups == g].sum() ** 2 / (groups == g).sum() for g in set(groups))

    nh = {g: (host == g).sum() for g in set(host)}
    m_host = Q.strengths(n, len(nh), 1, sum(x * x for x in nh.values()) / n, (p * p).sum() - ss(host), ss(host) - p.sum() ** 2 / n)
    n2 = sum((path == g).sum() ** 2 / nh[host[path == g][0]] for g in set(path))
    m_path = Q.strengths(n, len(set(path)), len(nh), n2, (p * p).sum() - ss(path), ss(path) - ss(host))
    for i, r in enumerate(out):
        h = (p[host == host[i]].sum() - p[i] + m_host * mu) / (nh[host[i]] - 1 + m_host)
        q = (p[path == path[i]].sum() - p[i] + m_path * h) / ((path == path[i]).sum() - 1 + m_path)
        odds = p[i] / (1 - p[i]) * q / (1 - q) / (mu / (1 - mu))
        assert r.host_posterior == pytest.approx(h) and r.path_posterior == pytest.approx(q) and r.quality == pytest.approx(odds / (1 + odds))
    assert site


def test_sparse_sites_are_shrunk(spark):
    """A site with one document stays near the global mean; one with many goes its own way."""
    rows, labels = docs(300, 5)
    bad = [awkward.row(1000 + i, "BUY!! NOW!! ### $$$ " * 5, "en", "bad") for i in range(60)]
    lone = [awkward.row(2000, "BUY!! NOW!! ### $$$ " * 5, "en", "lone"), awkward.row(2001, awkward.prose(77, 60), "en", "lone")]
    df = awkward.frame(spark, rows + bad + lone)
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in Q.judge(df, model).collect()}
    mean = np.mean([r.evidence for r in out.values()])
    assert out[1000].path_posterior < 0.3 * mean < out[2001].path_posterior


def test_awkward_and_empty(spark):
    df = awkward.frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (7, None, 0), (9, 0, 0), (16, 1, 1), (99, 0, 0), (16, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.judge(df, Q.fit(df, labels)).collect()
    assert len(out) == df.count() and all(0 <= r.quality <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.evidence, 6) for r in Q.judge(df, Q.fit(df, none)).collect()} == {0.5}
    assert Q.judge(awkward.empty(spark), Q.fit(awkward.empty(spark), labels)).count() == 0

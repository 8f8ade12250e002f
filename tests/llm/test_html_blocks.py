import duckdb
import pandas as pd

from tarnfold.llm import html_blocks as H

LONG = "words that go on for quite a while, so that a line of them is longer than a heading or a link would be; "
PAGES = [
    (1, f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li>Old</li></ul></nav><article><h1>Head</h1><p>{LONG}<b>bold</b></p><p>{LONG}</p></article><footer>&copy; us &amp; them</footer></body></html>"),
    (2, None),
    (3, ""),
    (4, "no markup"),
    (5, LONG * 300),
    (5, LONG * 300),
    (6, "<p>short</p>" * 50),
    (7, f"<script>var x = '<p>{LONG}</p>';</script><div>{LONG}</div><div>{LONG}</div><!-- <p>{LONG * 3}</p> --><p>a &lt;b&gt; &amp;lt; c&nbsp;d</p>"),
    (8, "<<<>>> < p >< /p> <p" + LONG),
    (None, f"<p>{LONG * 4}\x01\x02</p>"),
    (9, "".join(f"<p>{LONG}{i}</p>" for i in range(2000))),
    (10, f"<p>{LONG * 3}</p>\r\n<section>x</section><p>tail {LONG * 3}</p><header>top</header>"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(i, h, "u", 1, "dot") for i, h in rows], "page_id long, html string, url string, main int, `a.b` string")


def test_against_sql(spark):
    rows = [(k, h) for k, (_, h) in enumerate(PAGES)]
    got = {r.page_id: (r.main_text, r.n_lines) for r in H.extract(frame(spark, rows)).collect()}
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(rows, columns=["page_id", "html"]))
    assert got == {i: (t, n) for i, t, n in ((r[0], r[1], r[2]) for r in c.sql(f"SELECT page_id, main_text, n_lines FROM ({H.ORACLE_SQL})").fetchall())}


def test_what_is_kept(spark):
    got = {r.page_id: r.main_text for r in H.extract(frame(spark)).collect()}
    assert got[1] == f"Head\n{LONG}bold\n{LONG.strip()}"
    assert got[2] is None and got[3] == "" and got[4] == "" and got[6] == ""
    assert "var x" not in got[7] and got[7].endswith("a <b> &lt; c d")
    assert len(got[9].split("\n")) == 2000
    assert got[10].split("\n")[0].startswith("words") and "top" not in got[10]
    assert len(H.extract(frame(spark)).collect()) == len(PAGES)


def test_added_column_and_empty(spark):
    df = frame(spark)
    out = H.add_main_text(df)
    assert out.columns == [*df.columns, "main_text"] and out.count() == len(PAGES)
    assert H.add_main_text(df, to="URL").columns == [*df.columns, "_URL"]
    assert H.add_main_text(df, to="c0").columns == [*df.columns, "c0"]
    assert H.extract(frame(spark, [])).count() == 0

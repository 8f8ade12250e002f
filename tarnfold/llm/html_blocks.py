"""Main text of HTML pages by the distribution of line blocks.

1. Markup goes: comments, scripts, styles and other unseen elements with their content, whichever opens first; tags of block elements
   become line ends, those of sections several, all other tags nothing; the commonest character references are resolved and
   white space is collapsed. Line ends of the source are white space.
2. The block at line i is the length of lines i to i + window - 1 together.
3. A dive is a line whose block is empty. A surge is a line with text whose block exceeds surge_chars and is not
   its run's last, or that alone has more than lone_chars. From the first surge after a dive up to the next dive, text is kept.

All of it is built-in expressions within a row: one scan, no shuffle, no Python.

Defined results: null html gives null text and 0 lines; html without text, or without a surge, gives empty text. Repeated rows and null ids are kept as they are.
Lines are compared by length alone, so ties need no rule. Pages are taken whole, of any length. Other columns are passed on
by add_main_text; where the name of its own column is taken, in any case, underscores come before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 3
SURGE_CHARS = 100
LONE_CHARS = 250
UNSEEN = ("script", "style", "noscript", "template", "svg", "head", "select", "button")
SECTIONS = "article|aside|header|footer|nav|main|section|form|body|table"
BLOCKS = "p|div|br|li|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6|tr|td|th|thead|tbody|tfoot|caption|fieldset|blockquote|pre|hr|figure|figcaption|address|html|title"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
_SPACE = r"[ \t\r\f\x{a0}]+"


def _steps() -> list[tuple[str, str]]:
    """Patterns, in RE2's and Java's common language, and what replaces their matches."""
    unseen = "|".join(["<!--.*?-->", *(f"<{tag}(?:[ \\t\\r\\n/][^>]*)?>.*?</{tag}[ \\t\\r\\n]*>" for tag in UNSEEN)])
    tag = lambda names: f"(?i)</?(?:{names})(?:[ \\t/][^>]*)?>"
    return [(f"(?is){unseen}", " "), ("[\\r\\n]", " "), (tag(SECTIONS), "\n" * WINDOW), (tag(BLOCKS), "\n"), ("<[A-Za-z/!?][^>]*>", "")]


def lines_of(html: Column) -> Column:
    """The visible lines, blank ones included."""
    for pattern, to in _steps():
        html = F.translate(html, "\r\n", "  ") if pattern == "[\\r\\n]" else F.regexp_replace(html, pattern, to)
    for name, to in REFERENCES:
        html = F.replace(html, F.lit(name), F.lit(to))
    return F.transform(F.split(F.regexp_replace(html, _SPACE, " "), "\n", -1), lambda x: F.trim(x))


def main_text(html: Column, window: int = WINDOW, surge_chars: int = SURGE_CHARS, lone_chars: int = LONE_CHARS) -> tuple[Column, Column]:
    """The kept text, and the number of lines that hold any text at all."""
    lines = lines_of(F.regexp_replace(html, "[\\x01\\x02]", " "))

    def text_of(lines: Column) -> Column:
        blocks = F.transform(lines, lambda _, i: F.aggregate(F.slice(lines, i + 1, F.lit(window)), F.lit(0), lambda a, x: a + F.length(x)))

        def marked(blocks: Column) -> Column:
            def mark(x, i):
                block = F.get(blocks, i)
                after = F.coalesce(F.get(blocks, i + 1), F.lit(0))
                surge = (x != "") & (((block > surge_chars) & (after > 0)) | (F.length(x) > lone_chars))
                return F.when(block == 0, "\x01").when(surge, F.concat(F.lit("\x02"), x)).otherwise(x)

            return F.array_join(F.transform(lines, mark), "\n")

        # a dive ends a run; a run is kept from its first surge on
        runs = F.split(_let(blocks, marked), "\x01", -1)
        kept = F.transform(runs, lambda r: F.when(F.instr(r, "\x02") > 0, F.substring(r, F.instr(r, "\x02"), F.length(r))).otherwise(""))
        joined = F.regexp_replace(F.array_join(kept, "\n"), "[\n\x02]*\n[\n\x02]*", "\n")
        return F.btrim(F.replace(joined, F.lit("\x02"), F.lit("")), F.lit("\n"))

    return _let(lines, text_of), F.size(F.filter(lines, lambda x: x != ""))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable, not a copied expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add_main_text(pages: DataFrame, html_col: str = "html", to: str = "main_text", window: int = WINDOW, surge_chars: int = SURGE_CHARS, lone_chars: int = LONE_CHARS) -> DataFrame:
    """pages with column `to`, under a free name."""
    common.need(pages, html_col)
    names, to = pages.columns, common.free_name(pages, to)
    pages, html_col = common.numbered(pages, html_col)
    return pages.select("*", main_text(F.col(html_col), window, surge_chars, lone_chars)[0].alias("kept")).toDF(*names, to)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", window: int = WINDOW, surge_chars: int = SURGE_CHARS, lone_chars: int = LONE_CHARS) -> DataFrame:
    """(page_id, main_text, n_lines) of every page; n_lines counts the lines with text, kept or not."""
    pages, id_col, html_col = common.numbered(pages, id_col, html_col)
    text, lines = main_text(F.col("html"), window, surge_chars, lone_chars)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return narrow.select("page_id", text.alias("main_text"), F.when(F.col("html").isNotNull(), lines).otherwise(0).cast("bigint").alias("n_lines"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    value = "regexp_replace(html, '[\\x01\\x02]', ' ', 'g')"
    quote = lambda x: "'" + x.replace("'", "''") + "'" if "\n" not in x else "chr(10)" if x == "\n" else "repeat(chr(10), " + str(len(x)) + ")"
    for pattern, to in _steps():
        value = f"regexp_replace({value}, {quote(pattern)}, {quote(to)}, 'g')"
    for name, to in REFERENCES:
        value = f"replace({value}, {quote(name)}, {quote(to)})"
    value = f"string_split(regexp_replace({value}, {quote(_SPACE)}, ' ', 'g'), chr(10))"
    return f"""
WITH cut AS (SELECT page_id, {value} AS lines FROM pages WHERE html IS NOT NULL),
one AS (SELECT page_id, trim(unnest(lines)) AS line, generate_subscripts(lines, 1) AS i FROM cut),
sized AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS block FROM one
),
looked AS (SELECT *, coalesce(lead(block) OVER (PARTITION BY page_id ORDER BY i), 0) AS after FROM sized),
runs AS (
  SELECT *, line <> '' AND (block > {SURGE_CHARS} AND after > 0 OR length(line) > {LONE_CHARS}) AS surge,
    sum(CASE WHEN block = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM looked
),
first AS (SELECT *, min(CASE WHEN surge THEN i END) OVER (PARTITION BY page_id, run) AS from_line FROM runs)
SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> '' AND i >= from_line), '') AS main_text,
  CAST(count(*) FILTER (WHERE line <> '') AS BIGINT) AS n_lines
FROM first GROUP BY page_id
UNION ALL SELECT page_id, NULL, 0 FROM pages WHERE html IS NULL
"""


ORACLE_SQL = _oracle()

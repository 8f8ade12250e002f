"""Queries over sources, sinks, the store, collaborators and streams: what goes out comes back, over whole tables."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from .. import workflow
from ..functions import expr
from ..operators import candidates, evidence, index, store
from ..runtime import importable, work_folder
from ..sources import api, archives, files
from ..sources.report_store import ReportStore
from ..streaming import ledger as stream_ledger
from . import tables as t
from .catalogue import _drained, _events_stream, _phrased, query
from .tables import CUSTOMERS, FILINGS, FRAGMENTS, LEDGER, table

#: subfolders that many files are spread over
PARTS = 256
SITE = "https://filings.example.org"
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _put(rows, folder: str, name, content, parts: int = 0):
    """Write content, bytes or text, of each row as a file; from tasks, into the shared folder, or into so many subfolders by a hash of the name, which tasks can share out."""

    def write(batches):
        system, inner = pafs.FileSystem.from_uri(folder)
        below = [f"{inner}/{k:03x}" for k in range(parts)] or [inner]
        for x in below:
            system.create_dir(x, recursive=True)
        for b in batches:
            for n, c in zip(b.column("name").to_pylist(), b.column("content")):
                with system.open_output_stream(f"{below[zlib.crc32(n.encode()) % len(below)]}/{n}") as out:
                    out.write(c.as_buffer())  # no copy: a batch may be large
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    importable(rows.sparkSession)
    rows.select(name.alias("name"), content.cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


# --- files


@query("SELECT CAST(c_custkey AS VARCHAR) AS lei, c_name AS entity_name, n_name AS country, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey")
def csv_index(spark, d):
    """The index as CSV with a UTF-8 mark, and back under its schema."""
    folder = work_folder(spark, "csv")
    balance = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("lei"), F.col("c_acctbal").alias("balance"))
    files.write_csv(t.customers(spark, d).join(balance, "lei"), folder)
    return files.read_index(spark, folder, "lei string, entity_name string, country string, balance double")


@query(f"WITH {LEDGER} SELECT seq, CAST(report_id AS VARCHAR) AS report_id, status, esg_flag FROM ledger")
def csv_ledger(spark, d):
    """A ledger appended to in three turns, one for each status."""
    folder = work_folder(spark, "ledger")
    rows = t.ledger(spark, d).withColumn("report_id", F.col("report_id").cast("string"))
    shaped = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in spark.createDataFrame([], files.schemas.LEDGER).dtypes))
    for status in ("ok", "skip", "fail"):
        files.append_ledger(shaped.where(F.col("status") == status), folder)
    return files.read_ledger(spark, folder).select("seq", "report_id", "status", "esg_flag")


@query(f"WITH {LEDGER} SELECT seq, report_id FROM ledger WHERE status = 'fail'")
def failure_list(spark, d):
    folder = work_folder(spark, "failures")
    files.write_failures(t.ledger(spark, d).select("seq", "report_id", "status"), folder)
    return files.read_index(spark, folder, "seq bigint, report_id bigint, status string").select("seq", "report_id")


@query(f"WITH {FILINGS}, {CUSTOMERS} SELECT country, CAST(fiscal_year AS INTEGER) AS fiscal_year, count(*) AS n FROM filings JOIN customers USING (lei) WHERE country = 'FRANCE' OR country = 'NATION_6' GROUP BY ALL")
def partitioned_table(spark, d):
    """A table partitioned by country and year; the filter on a country reads its folders only."""
    folder = work_folder(spark, "table")
    rows = t.filings(spark, d).join(t.customers(spark, d), "lei").repartition("country", "fiscal_year")
    files.write_table(rows.select("api_id", "lei", "country", "fiscal_year"), folder, ("country", "fiscal_year"))
    back = spark.read.parquet(folder).where(F.col("country").isin("FRANCE", "NATION_6"))
    return back.groupBy("country", F.col("fiscal_year").cast("int").alias("fiscal_year")).agg(F.count("*").alias("n"))


@query("SELECT page_id || '.html' AS file, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS actual_sha FROM pages")
def file_inventory(spark, d):
    folder = work_folder(spark, "inventory")
    _put(table(spark, d, "pages"), folder, F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), PARTS)
    return files.inventory(spark, folder)


@query("SELECT page_id || '.zip' AS file, page_id % 5 <> 0 AS zip_ok, CAST(page_id % 5 <> 0 AND page_id % 12 < 10 AS INTEGER) AS esg_flag FROM pages")
def zip_packages(spark, d):
    """Each page in a package behind another member; every fifth package is cut off, and so no archive."""
    folder = work_folder(spark, "packages")

    def pack(batches):
        for b in batches:
            made = []
            for i, html in zip(b["page_id"], b["html"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("about.txt", "ESRS")
                    z.writestr("report.xhtml", html)
                made.append(out.getvalue() if i % 5 else out.getvalue()[:40])
            yield pd.DataFrame({"page_id": b["page_id"], "content": made})

    importable(spark)
    _put(_phrased(spark, d).mapInPandas(pack, "page_id long, content binary"), folder, F.concat(F.col("page_id").cast("string"), F.lit(".zip")), F.col("content"), PARTS)
    return archives.packages(spark, folder).select("file", "zip_ok", "esg_flag")


@query(f"""WITH x AS (SELECT CAST(page_id AS VARCHAR) AS report_id, string_split(html, '</p>') AS parts FROM pages), y AS (SELECT report_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS page_index, unnest(parts) AS native_text FROM x)
SELECT report_id, page_index, native_text, 10.0::DOUBLE AS width, 20.0::DOUBLE AS height, list_filter([CASE WHEN {_STRIPPED.format('native_text')} = '' THEN 'native_text_empty' END, CASE WHEN contains(native_text, '<li') THEN 'table_candidate_detected' END], lambda f: f IS NOT NULL) AS quality_flags FROM y""")
def document_pages(spark, d):
    """Documents as bytes, cut into pages by a reader that is handed in."""
    folder = work_folder(spark, "documents")
    _put(table(spark, d, "pages"), folder, F.concat(F.col("page_id").cast("string"), F.lit(".pdf")), F.col("html"), PARTS)
    reader = lambda content: [(p, 10.0, 20.0, "<li" in p) for p in content.decode().split("</p>")]
    return archives.documents(spark, folder, reader).select("report_id", "page_index", "native_text", "width", "height", "quality_flags")


@query("SELECT page_id, sha256(html) AS sha256, regexp_replace(regexp_replace(regexp_extract(url, '([^/]+)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file_name FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, NULL, 'broken' FROM pages WHERE page_id % 4 = 0")
def upload_decode(spark, d):
    """Base64 bodies; every fourth is no base64."""
    broken = F.col("page_id") % 4 == 0
    rows = table(spark, d, "pages").select("page_id", F.when(broken, "%%%").otherwise(F.base64(F.col("html").cast("binary"))).alias("body"), F.when(broken, "x/broken").otherwise(F.col("url")).alias("name"))
    return files.decode_upload(rows).select("page_id", F.sha2("content", 256).alias("sha256"), "file_name")


# --- the paginated API


def _api_folder(spark, d) -> str:
    """Bodies of API pages, 40 filings a page and a walk a country, as files in the shared folder."""
    from pyspark.sql import Window

    folder = work_folder(spark, "api")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy("o_orderkey")
    rows = rows.withColumn("page", F.floor((F.row_number().over(w) - 1) / 40))
    known = F.col("c_acctbal") > 0
    date = t.day("o_orderdate")
    fxo = F.concat_ws("-", F.concat(F.lit("L"), F.col("o_custkey").cast("string")), date, F.lit("ESEF"), F.lit("GB"), (F.col("o_orderkey") % 4).cast("string"))
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.struct(
            fxo.alias("fxo_id"), date.alias("period_end"), F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("sha256"), F.substring("o_orderpriority", 1, 1).cast("int").alias("error_count"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("/p/"), F.col("o_orderkey").cast("string"), F.lit(".zip"))).alias("package_url"),
        ).alias("attributes"),
        F.struct(F.struct(F.struct(F.col("o_custkey").cast("string").alias("id")).alias("data")).alias("entity")).alias("relationships"),
    )
    entity = F.struct(F.col("o_custkey").cast("string").alias("id"), F.lit("entity").alias("type"), F.struct(F.col("c_name").alias("name"), F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("identifier")).alias("attributes"))
    pages = rows.groupBy("c_nationkey", "page").agg(F.collect_list(item).alias("data"), F.collect_set(F.when(known, entity)).alias("included"))
    last = F.max("page").over(Window.partitionBy("c_nationkey"))
    next_ = F.when(F.col("page") < last, F.concat(F.lit(f"{SITE}/api/filings?country="), F.col("c_nationkey").cast("string"), F.lit("&n="), (F.col("page") + 1).cast("string")))
    body = F.to_json(F.struct("data", "included", F.struct(next_.alias("next")).alias("links")))
    _put(pages.select("c_nationkey", "page", body.alias("body")), folder, F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("page").cast("string")), F.col("body"))
    return folder


def _file_fetch(folder: str):
    def fetch(url: str):
        from urllib.parse import parse_qs, urlparse

        asked = parse_qs(urlparse(url).query)
        country = (asked.get("country") or asked.get("filter[country]"))[0]
        system, inner = pafs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{inner}/{country}-{asked.get('n', ['0'])[0]}") as f:
            return 200, {}, f.read()

    return fetch


_API = """api AS (SELECT CAST(o_orderkey AS VARCHAR) AS api_id, CASE WHEN c_acctbal > 0 THEN 'I' ELSE 'L' END || o_custkey AS lei, CASE WHEN c_acctbal > 0 THEN c_name END AS entity_name, 'GB' AS country, 'ESEF' AS report_type, CAST(o_orderkey % 4 AS INTEGER) AS seq,
  strftime(o_orderdate, '%Y-%m-%d') AS period_end, strftime(o_orderdate, '%Y') AS fiscal_year, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, substr(o_orderpriority, 1, 1) AS error_count,
  CASE WHEN o_orderstatus <> 'P' THEN 'https://filings.example.org/p/' || o_orderkey || '.zip' END AS package_url FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _crawled(spark, d):
    countries = [str(r["n_nationkey"]) for r in table(spark, d, "nation").select("n_nationkey").collect()]
    have = {str(r["c_nationkey"]) for r in table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_nationkey").distinct().collect()}
    return api.filings_from_api(spark, _file_fetch(_api_folder(spark, d)), f"{SITE}/api/filings", [c for c in countries if c in have], delay=0)


@query(f"WITH {_API} SELECT api_id, lei, entity_name, country, report_type, seq, period_end, fiscal_year, sha256, error_count, package_url FROM api")
def api_walk(spark, d):
    """All filings of the API: pages by their links, a task a country, entities joined within a page."""
    return _crawled(spark, d).select("api_id", "lei", "entity_name", "country", "report_type", "seq", "period_end", "fiscal_year", "sha256", "error_count", "package_url")


@query(f"WITH {_API} SELECT api_id, lei, period_end FROM api WHERE country = 'GB' AND CAST(fiscal_year AS INTEGER) IN (1995, 1996, 1998) AND package_url IS NOT NULL ORDER BY lei, period_end, api_id LIMIT 100")
def filing_selection(spark, d):
    """The first hundred filings of a country and of years that have a package."""
    return index.select_filings(_crawled(spark, d), "gb", [1995, 1996, 1998], limit=100).select("api_id", "lei", "period_end")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE length('body of ' || o_orderkey) END AS n_bytes, o_orderkey % 7 <> 0 AND o_orderstatus <> 'F' AS ok,
  CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderstatus = 'F' THEN 'hash differs' ELSE '' END AS msg FROM orders""")
def package_download(spark, d):
    """Packages through a fetch that is handed in: some are gone, some have another hash than the index says."""
    key = F.col("o_orderkey").cast("string")
    sha = F.when(F.col("o_orderstatus") == "F", "00").when(F.col("o_orderstatus") == "O", F.upper(F.sha2(F.concat(F.lit("body of "), key), 256)))
    wanted = table(spark, d, "orders").select(key.alias("report_id"), F.concat(F.lit("u/"), key).alias("package_url"), F.concat(key, F.lit(".zip")).alias("file"), sha.alias("sha256"))

    def fetch(url: str):
        number = url.rpartition("/")[2]
        return (404, {}, b"") if int(number) % 7 == 0 else (200, {}, f"body of {number}".encode())

    out = api.download(wanted, fetch, lambda name, body: None, delay=0)
    return out.select("report_id", F.col("n_bytes"), "ok", F.when(F.col("msg").contains("404"), "missing").otherwise(F.col("msg")).alias("msg"))


@query("""SELECT CAST(event_id AS VARCHAR) AS request_id, event_type AS model_id, '{"choices": [{"message": {"content": "' || event_type || ' ' || length(props) || '"}}]}' AS response, event_type || ' ' || length(props) AS content FROM events""")
def completer_answers(spark, d):
    """Requests through a completer that is handed in, and the message in each answer."""
    asked = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("request_id"), F.col("user_id").cast("string").alias("report_id"), F.col("event_type").alias("model_id"), F.lit("structured_extract").alias("task_type"), F.col("props").alias("prompt"),
    )
    answers = api.complete_tasks(asked, lambda model, prompt: json.dumps({"choices": [{"message": {"content": f"{model} {len(prompt)}"}}]}))
    return answers.select("request_id", "model_id", "response", candidates.message_content(F.col("response")).alias("content"))


# --- expressions


@query("SELECT o_orderkey, string_split(o_custkey || '-A-' || o_orderpriority, '-')[1] AS lei FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0")
def lei_prefix(spark, d):
    """The text before a filing id's first hyphen, else the entity's identifier."""
    fxo = F.when(F.col("o_orderkey") % 3 != 0, F.concat_ws("-", F.col("o_custkey").cast("string"), F.lit("A"), F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", expr.lei_by_prefix(fxo, F.col("o_custkey").cast("string")).alias("lei"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity AS width, l_tax - l_discount AS height FROM lineitem")
def box_sizes(spark, d):
    box = expr.box_size(F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box["width"].alias("width"), box["height"].alias("height"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS row_count, CAST(list_max(list_transform(string_split(text, chr(10)), lambda r: len(string_split(r, ' ')))) AS INTEGER) AS column_count FROM documents WHERE text IS NOT NULL")
def table_shapes(spark, d):
    """Texts read as tables: lines are rows, blanks part cells."""
    cells = F.transform(F.split("text", "\n", -1), lambda r: F.split(r, " ", -1))
    shape = archives.table_shape(cells)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", shape["row_count"].alias("row_count"), shape["column_count"].alias("column_count"))


@query(f"WITH {FRAGMENTS} SELECT id, kind IN ('user', 'note') AND kind = 'note' AS ok FROM fragments UNION ALL SELECT id || 't', true FROM fragments")
def fragment_kinds(spark, d):
    """Roles of a conversation are no kinds of evidence, text blocks are."""
    f = t.fragments(spark, d)
    return f.select("id", expr.fragment_kind_ok(F.col("kind")).alias("ok")).unionByName(f.select(F.concat("id", F.lit("t")).alias("id"), expr.fragment_kind_ok(F.lit("text_block")).alias("ok")))


@query("SELECT event_id, event_type || chr(10) || props AS content FROM events")
def message_parts(spark, d):
    """Messages that are lists of parts, one of them a bare string."""
    parts = F.concat(F.lit("["), F.to_json(F.struct(F.col("event_type").alias("text"))), F.lit(","), F.to_json(F.struct(F.col("props").alias("text"))), F.lit("]"))
    response = F.concat(F.lit('{"choices": [{"message": {"content": '), parts, F.lit("}}]}"))
    return table(spark, d, "events").select("event_id", candidates.message_content(response).alias("content"))


@query("""SELECT event_id, CAST(0 AS INTEGER) AS item_index, event_type AS raw_label, 'one' AS raw_text FROM events UNION ALL SELECT event_id, CAST(1 AS INTEGER), 'second', 'user ' || user_id FROM events
UNION ALL SELECT event_id, CAST(2 AS INTEGER), 'cloud_disclosure_3', 'cloud_disclosure_3' FROM events WHERE event_type = 'click'""")
def candidate_items(spark, d):
    """Answers with two items, and with three for clicks: each keeps its place, and empty fields are filled in turn."""
    first = F.concat(F.lit('{"raw_label": "'), F.col("event_type"), F.lit('", "raw_text": "one"}'))
    second = F.concat(F.lit('{"label": "second", "summary": "user '), F.col("user_id").cast("string"), F.lit('"}'))
    third = F.when(F.col("event_type") == "click", ', {"raw_label": ""}').otherwise("")
    content = F.concat(F.lit('{"disclosures": ['), first, F.lit(", "), second, third, F.lit("]}"))
    rows = table(spark, d, "events").withColumn("response", F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))))
    return candidates.parse(rows, F.col("response"), F.array().cast("array<string>"), ["event_id"]).select("event_id", "item_index", "raw_label", "raw_text")


_OWN = f"{FRAGMENTS}, own AS (SELECT page_index, list(id ORDER BY block_index) AS ids FROM fragments GROUP BY page_index)"


@query(f"""WITH {_OWN} SELECT o.page_index, o.ids || coalesce(b.ids, []) || coalesce(a.ids, []) AS refs FROM own o LEFT JOIN own b ON b.page_index = o.page_index - 1 LEFT JOIN own a ON a.page_index = o.page_index + 1""")
def packet_context(spark, d):
    """A packet's evidence with that of the pages before and after as context."""
    p = evidence.with_context(evidence.packets(t.fragments(spark, d)))
    return p.select("page_index", evidence.packet_refs(evidence.all_items(F.col("primary"), F.col("context"))).alias("refs"))


# --- store


def _stored(spark, d) -> ReportStore:
    """The local workflow over all documents, a report for each source, saved twice: the second run replaces the first."""
    held = ReportStore(spark, work_folder(spark, "store"))
    pages = table(spark, d, "documents").select(F.col("source").alias("report_id"), F.col("doc_id").cast("int").alias("page_index"), F.col("text").alias("native_text"))
    for _ in range(2):
        held.save_state(workflow.run_local(pages))
    return held


_FILLED = _STRIPPED.format("coalesce(text, '')")


@query(f"SELECT source AS report_id, CAST(count(*) AS INTEGER) AS page_count, count(*) FILTER (WHERE {_FILLED} <> '') AS packet_count, count(*) FILTER (WHERE {_FILLED} <> '') AS disclosure_count, CAST(0 AS BIGINT) AS result_count, count(*) AS pages_in_document FROM documents GROUP BY source")
def stored_reports(spark, d):
    """Reports as they are listed, and the pages that each one's document holds as JSON."""
    held = _stored(spark, d)
    document = held.read("reports").select("report_id", F.size(F.from_json("document_json", "pages array<struct<page_index:int>>")["pages"]).cast("bigint").alias("pages_in_document"))
    return held.listing().join(document, "report_id").select("report_id", "page_count", "packet_count", "disclosure_count", "result_count", "pages_in_document")


@query("SELECT source AS report_id, list(doc_id::INTEGER ORDER BY doc_id) AS page_indexes FROM documents WHERE source = 'src3' GROUP BY source")
def stored_report_detail(spark, d):
    """One report by its id."""
    return _stored(spark, d).detail("src3", pages=["page_index"]).select("report_id", F.col("pages.page_index").alias("page_indexes"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def strict_insert(spark, d):
    """Both halves of a table by status: no key occurs twice, or reading would raise."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return files.require_unique(store.insert_strict(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"), ["o_orderkey"]), ["o_orderkey"])


# --- streams


@query("SELECT DISTINCT user_id AS report_id, 'ok' AS status FROM events")
def stream_process(spark, d):
    """Work on a stream of items, each once, with outcomes by batch."""
    folder = work_folder(spark, "process")
    work = lambda items: items.select("report_id", F.lit("ok").alias("status"))
    stream = _events_stream(spark, d).select("report_id", "seq")
    for _ in range(2):  # the second start finds nothing new
        stream_ledger.process(stream, work, f"{folder}/done", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/done").select("report_id", "status")


@query(f"WITH {LEDGER} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, status, count(*) AS n FROM ledger JOIN events ON event_id = seq GROUP BY ALL")
def stream_windows(spark, d):
    out = _drained(stream_ledger.windowed(_events_stream(spark, d)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "status", "n")



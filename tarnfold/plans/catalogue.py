"""The query catalogue: name -> (query, SQL). Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expr
from ..runtime import work_folder
from ..operators import candidates, coverage, evidence, index, ledger, quality, routing, store
from ..streaming import ledger as stream_ledger
from . import tables as t
from .tables import CONTENT, CUSTOMERS, FILINGS, FRAGMENTS, LEDGER, MODELS, PRIMARY, table

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str]] = {}
BASE = "https://filings.example.org"
TYPES = ["F", "O", "P"]
YEARS = [str(y) for y in range(1992, 2002)]
FXO = r"^https?://([^/]+)/([a-z]{2})/([0-9]+)"


def query(sql: str):
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items()}


# --- index


@query(f"""WITH {PRIMARY}, raw AS (SELECT lei, period_end, count(*) AS n_raw FROM filings GROUP BY lei, period_end)
SELECT printf('R%06d', row_number() OVER (ORDER BY lei NULLS LAST, period_end NULLS LAST, api_id)) AS report_id, api_id, lei, period_end, n_versions, n_raw
FROM primary_filings JOIN raw USING (lei, period_end)""")
def primary_index(spark, d):
    return index.primary_index(t.filings(spark, d)).select("report_id", "api_id", "lei", "period_end", "n_versions", "n_raw")


@query(f"""WITH {FILINGS}, {CUSTOMERS}
SELECT api_id, lei, entity_name, country, period_end, fiscal_year, report_type FROM filings LEFT JOIN customers USING (lei) WHERE country = 'FRANCE' OR country = 'NATION_6'""")
def filing_projection(spark, d):
    rows = index.with_entities(t.filings(spark, d), t.customers(spark, d), "lei")
    return rows.where(F.col("country").isin("FRANCE", "NATION_6")).select("api_id", "lei", "entity_name", "country", "period_end", "fiscal_year", "report_type")


@query(f"""WITH {FILINGS} SELECT api_id, fiscal_year FROM filings WHERE TRY_CAST(fiscal_year AS INTEGER) IN (1996, 1997)""")
def year_filter(spark, d):
    return index.select_filings(t.filings(spark, d), years=[1996, 1997], need_url=False).select("api_id", "fiscal_year")


@query(f"""WITH {FILINGS}, {CUSTOMERS} SELECT api_id, coalesce(nullif(entity_name, ''), 'none') AS entity_name, coalesce(nullif(c.lei, ''), f.lei) AS lei
FROM filings f LEFT JOIN (SELECT customers.* FROM customers JOIN customer ON CAST(c_custkey AS VARCHAR) = lei WHERE c_acctbal > 0) c ON f.lei = c.lei""")
def entity_resolution(spark, d):
    solvent = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("lei"))
    known = t.customers(spark, d).join(solvent, "lei").withColumn("entity_id", F.col("lei")).withColumnRenamed("lei", "entity_lei")
    rows = index.with_entities(t.filings(spark, d).withColumn("entity_id", F.col("lei")), known)
    return rows.select("api_id", F.coalesce(expr.blank_to_null(F.col("entity_name")), F.lit("none")).alias("entity_name"), expr.first_filled(F.col("entity_lei"), F.col("lei")).alias("lei"))


@query("""SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS strict_year,
  CASE WHEN regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^20') THEN substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)
    ELSE nullif(regexp_extract(o_orderpriority, '(20[0-9]{2})', 1), '') END AS any_year,
  CAST(TRY_CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS INTEGER) AS INTEGER) AS report_year FROM orders""")
def fiscal_year(spark, d):
    o = table(spark, d, "orders").withColumn("pe", t.day("o_orderdate"))
    pe = F.col("pe")
    return o.select("o_orderkey", expr.fiscal_year(pe).alias("strict_year"), expr.fiscal_year_anywhere(pe, F.lit(None).cast("string"), F.col("o_orderpriority")).alias("any_year"), expr.report_year(pe).alias("report_year"))


@query("""WITH ids AS (SELECT o_orderkey, o_custkey || '-A-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || CASE WHEN o_orderkey % 7 = 0 THEN '12' ELSE 'ESEF' END || '-GB-' || (o_orderkey % 4) AS fxo FROM orders),
parsed AS (SELECT *, regexp_extract(fxo, '^(.+?)-([0-9]{4}-[0-9]{2}-[0-9]{2})-([[:alpha:]]+)-([A-Z][A-Z])-([0-9]+)$', ['lei', 'period_end', 'kind', 'country', 'seq']) AS p FROM ids)
SELECT o_orderkey, nullif(p.lei, '') AS lei, nullif(p.kind, '') AS report_type, nullif(p.country, '') AS country, TRY_CAST(p.seq AS INTEGER) AS seq FROM parsed""")
def filing_id_parse(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 7 == 0, "12").otherwise("ESEF")
    fxo = F.concat_ws("-", F.col("o_custkey"), F.lit("A"), t.day("o_orderdate"), kind, F.lit("GB"), F.col("o_orderkey") % 4)
    p = expr.filing_id_parts(fxo)
    return o.select("o_orderkey", p["lei"].alias("lei"), p["report_type"].alias("report_type"), p["country"].alias("country"), p["seq"].alias("seq"))


@query(f"""SELECT page_id, nullif(regexp_extract(url, '{FXO}', 1), '') AS host, nullif(regexp_extract(url, '{FXO}', 2), '') AS lang, TRY_CAST(regexp_extract(url, '{FXO}', 3) AS INTEGER) AS number FROM pages""")
def url_parse(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", expr.part_of(u, FXO, 1).alias("host"), expr.part_of(u, FXO, 2).alias("lang"), expr.part_of(u, FXO, 3).try_cast("int").alias("number"))


@query(f"""WITH paths AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://[^/]+', '') ELSE url END AS path FROM pages)
SELECT page_id, CASE WHEN path LIKE '/%' THEN '{BASE}' || path ELSE path END AS url FROM paths""")
def url_absolutize(spark, d):
    path = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://[^/]+", "")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", expr.absolute_url(path, BASE).alias("url"))


@query("""SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 120) AS safe,
  regexp_replace(regexp_replace(regexp_extract(url, '([^/]+)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS upload,
  regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g')[1:120] || '_2024_' || coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE substr(sha256(url), 1, 8) END, ''), 'nohash') || '.zip' AS package FROM pages""")
def safe_filename(spark, d):
    u = F.col("url")
    sha = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.sha2(u, 256))
    return table(spark, d, "pages").select("page_id", expr.safe_name(u).alias("safe"), expr.safe_upload_name(u).alias("upload"), expr.package_name(u, F.lit("2024"), sha).alias("package"))


@query(f"""WITH {FILINGS}, {CUSTOMERS} SELECT api_id, 'esef/' || country || '/' || fiscal_year || '/' || lei || '_' || period_end || '_' || substr(sha256, 1, 8) || '.zip' AS object_key FROM filings JOIN customers USING (lei)""")
def object_key(spark, d):
    f = t.filings(spark, d).join(t.customers(spark, d), "lei")
    return f.select("api_id", expr.object_key(F.col("country"), F.col("fiscal_year"), expr.package_name(F.col("lei"), F.col("period_end"), F.col("sha256"))).alias("object_key"))


@query("SELECT doc_id, lower(sha256(coalesce(text, ''))) AS sha256 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", expr.hash_of(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256"))


@query("""SELECT doc_id, sha256(text) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC NULLS LAST, doc_id) = 1""")
def dedup_content(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("processed"))
    return index.dedup_content(rows, id_col="doc_id").select("doc_id", "sha256")


@query(f"""WITH {PRIMARY} SELECT api_id, lei, period_end, n_versions FROM primary_filings""")
def dedup_restatement(spark, d):
    return index.dedup_restatement(index.dedup_content(t.filings(spark, d))).select("api_id", "lei", "period_end", "n_versions")


# --- coverage


def _pivot(types: list[str], column: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{x}') AS \"{x}\"" for x in types)


@query(f"""WITH {PRIMARY} SELECT fiscal_year, {_pivot(TYPES, 'report_type')}, count(*) AS total FROM primary_filings WHERE fiscal_year IS NOT NULL AND report_type IS NOT NULL GROUP BY fiscal_year""")
def coverage_pivot(spark, d):
    return coverage.by_year_and_type(index.dedup_restatement(index.dedup_content(t.filings(spark, d))), TYPES)


@query(f"""WITH {FILINGS}, {CUSTOMERS}, y AS (SELECT country, CASE WHEN api_id % 50 = 0 THEN '未知' ELSE fiscal_year END AS fiscal_year FROM filings JOIN customers USING (lei))
SELECT country, {_pivot([*YEARS, '未知'], 'fiscal_year')}, count(*) FILTER (WHERE fiscal_year IN ({", ".join(f"'{y}'" for y in [*YEARS, '未知'])})) AS total FROM y GROUP BY country""")
def coverage_pivot_country(spark, d):
    f = t.filings(spark, d).join(t.customers(spark, d), "lei").withColumn("fiscal_year", F.when(F.col("api_id") % 50 != 0, F.col("fiscal_year")))
    return coverage.by_country_and_year(f, YEARS)


@query(f"""WITH {FILINGS}, {CUSTOMERS} SELECT CASE WHEN country = 'NATION_3' THEN NULL ELSE country END AS country, CAST(fiscal_year AS INTEGER) AS report_year, count(*) AS collected FROM filings JOIN customers USING (lei) GROUP BY 1, 2""")
def coverage_view(spark, d):
    f = t.filings(spark, d).join(t.customers(spark, d), "lei")
    return coverage.view(f.select(F.when(F.col("country") != "NATION_3", F.col("country")).alias("country"), expr.report_year(F.col("period_end")).alias("report_year")))


@query(f"""WITH {FILINGS} SELECT count(DISTINCT nullif(CASE WHEN api_id % 9 = 0 THEN '' ELSE lei END, '')) AS entities FROM filings""")
def entity_count(spark, d):
    return coverage.entity_count(t.filings(spark, d).withColumn("lei", F.when(F.col("api_id") % 9 == 0, "").otherwise(F.col("lei"))))


_RATE = f"""{FILINGS}, {CUSTOMERS},
collected AS (SELECT country, CAST(fiscal_year AS INTEGER) AS report_year, count(DISTINCT lei) AS collected FROM filings JOIN customers USING (lei) GROUP BY 1, 2),
expected AS (SELECT country, y AS report_year, count(*) AS expected FROM customers, (SELECT CAST(unnest(range(1992, 2001)) AS INTEGER) AS y) GROUP BY 1, 2),
rates AS (SELECT country, report_year, coalesce(collected, 0) AS collected, coalesce(expected, 0) AS expected,
  CASE WHEN coalesce(expected, 0) > 0 THEN coalesce(collected, 0) / expected END AS rate FROM collected FULL JOIN expected USING (country, report_year))"""


def _rates(spark, d):
    f = t.filings(spark, d).join(t.customers(spark, d), "lei")
    have = f.groupBy("country", expr.report_year(F.col("period_end")).alias("report_year")).agg(F.count_distinct("lei").alias("collected"))
    years = spark.range(1992, 2001).select(F.col("id").cast("int").alias("report_year"))
    due = t.customers(spark, d).groupBy("country").agg(F.count("*").alias("expected")).crossJoin(years)
    return coverage.rate(have, due, ["country", "report_year"])


@query(f"WITH {_RATE} SELECT * FROM rates")
def coverage_rate(spark, d):
    return _rates(spark, d)


@query(f"WITH {_RATE} SELECT r.*, due, coalesce(rate, 0.0) * coalesce(due, 0) AS forecast FROM rates r LEFT JOIN (SELECT country, count(*) AS due FROM customers GROUP BY country) o USING (country)")
def coverage_forecast(spark, d):
    due = t.customers(spark, d).groupBy("country").agg(F.count("*").alias("due"))
    return coverage.forecast(_rates(spark, d), due, ["country"])


@query(f"""WITH {FILINGS}, years AS (SELECT DISTINCT lei, CAST(fiscal_year AS INTEGER) AS y FROM filings), span AS (SELECT lei, min(y) AS t1, max(y) AS t2 FROM years GROUP BY lei),
due AS (SELECT lei, t1, t2, CAST(unnest(generate_series(t1, greatest(t2, 2000))) AS INTEGER) AS missing_year FROM span)
SELECT due.*, CASE WHEN missing_year < t2 THEN 'interrupted' ELSE 'until_cutoff' END AS kind FROM due LEFT JOIN years ON due.lei = years.lei AND missing_year = y WHERE y IS NULL""")
def coverage_gap(spark, d):
    years = t.filings(spark, d).select("lei", F.col("fiscal_year").cast("int").alias("fiscal_year"))
    return coverage.gaps(years, cutoff=2000)


# --- audits


@query(f"""WITH {PRIMARY}
SELECT 'content hash is unique' AS check_name, count(*) - count(DISTINCT sha256) AS violations, count(*) = count(DISTINCT sha256) AS passed FROM primary_filings WHERE sha256 <> ''
UNION ALL SELECT 'entity and period are unique', count(*) - count(DISTINCT (lei, period_end)), count(*) = count(DISTINCT (lei, period_end)) FROM primary_filings
UNION ALL SELECT 'every filing has an entity', count(*), count(*) = 0 FROM primary_filings WHERE lei NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
UNION ALL SELECT 'versions add up to filings after content dedup', CAST(abs(v - c) AS BIGINT), v = c FROM (SELECT (SELECT sum(n_versions) FROM primary_filings) AS v, (SELECT count(*) FROM content) AS c)
UNION ALL SELECT 'raw counts add up to raw filings', CAST(abs(v - c) AS BIGINT), v = c FROM (SELECT (SELECT sum(n_raw) FROM primary_filings JOIN (SELECT lei, period_end, count(*) AS n_raw FROM filings GROUP BY ALL) USING (lei, period_end)) AS v, (SELECT count(*) FROM filings) AS c)""")
def invariant_audit(spark, d):
    raw = t.filings(spark, d)
    return quality.index_audit(raw, index.dedup_content(raw), index.primary_index(raw), t.customers(spark, d))


@query("""SELECT 'indicator key is unique' AS check_name, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS violations, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS passed FROM lineitem
UNION ALL SELECT 'status is in the vocabulary', count(*), count(*) = 0 FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'every value has a report', count(*), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def vocab_audit(spark, d):
    li = table(spark, d, "lineitem")
    return quality.audit(
        quality.repeated("indicator key is unique", li, "l_orderkey", "l_linenumber"),
        quality.check(quality.outside(li, "l_returnflag", {"A", "N"}), "status is in the vocabulary", F.count("*")),
        quality.check(quality.orphans(li, table(spark, d, "orders"), "l_orderkey", "o_orderkey"), "every value has a report", F.count("*")),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def indicator_duplicates(spark, d):
    return quality.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ignore_null=True)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_audit(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 0")
    return quality.orphans(table(spark, d, "orders"), known, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("""WITH looked AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'null lang' WHEN row_number() OVER (PARTITION BY sha256(text), lang = 'de' ORDER BY doc_id) > 1 THEN 'repeated sha' END AS reason FROM documents)
SELECT doc_id, coalesce(reason, 'good') AS reason FROM looked""")
def quarantine(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), F.sha2("text", 256).alias("sha"))
    good, bad = quality.quarantine(rows, ["lang"], "sha", [F.col("doc_id").asc()])
    return good.select("doc_id", F.lit("good").alias("reason")).unionByName(bad.select("doc_id", "reason"))


_FILES = """files AS (SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 11 = 0 THEN 'x' ELSE upper(sha256(text)) END AS expected_sha,
  CASE WHEN l.doc_id IS NOT NULL THEN sha256(text) END AS actual_sha, quality = 1 AS zip_ok, n_chars AS size FROM documents d LEFT JOIN labels l USING (doc_id)),
checked AS (SELECT doc_id, actual_sha IS NULL OR coalesce(size, 0) <= 0 AS missing, coalesce(expected_sha IS NULL OR lower(expected_sha) = actual_sha, false) AS sha_ok, coalesce(zip_ok, false) AS zip_ok FROM files)"""


def _files(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("_l", F.lit(1)), "doc_id", "left")
    sha = F.sha2("text", 256)
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 11 == 0, "x").otherwise(F.upper(sha)).alias("expected_sha"),
        F.when(F.col("_l") == 1, sha).alias("actual_sha"),
        (F.col("quality") == 1).alias("zip_ok"),
        F.col("n_chars").alias("size"),
    )


@query(f"WITH {_FILES} SELECT doc_id, missing, sha_ok, NOT missing AND NOT (sha_ok AND zip_ok) AS bad FROM checked")
def integrity_check(spark, d):
    return quality.integrity(_files(spark, d)).select("doc_id", "missing", "sha_ok", "bad")


@query(f"WITH {_FILES} SELECT count(*) FILTER (WHERE NOT missing) AS checked, count(*) FILTER (WHERE NOT missing AND NOT (sha_ok AND zip_ok)) AS bad, count(*) FILTER (WHERE missing) AS missing FROM checked")
def integrity_summary(spark, d):
    return quality.integrity_counts(quality.integrity(_files(spark, d)))


# --- ledger


def _inventory(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("size"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)")
def pending_packages(spark, d):
    return ledger.pending(table(spark, d, "documents").select("doc_id"), _inventory(spark, d), "doc_id")


@query("""WITH c AS (SELECT count(*) AS matched, count(l.doc_id) AS have FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality > 0) l USING (doc_id))
SELECT matched, have, matched - have AS todo, (matched - have) * 15 / 1024 AS todo_gb, (matched - have) * 15 / 1024 * CAST(1.2 AS DOUBLE) AS needed_gb FROM c""")
def volume_plan(spark, d):
    return ledger.plan(table(spark, d, "documents").select("doc_id"), _inventory(spark, d), "doc_id")


_LATEST = f"{LEDGER}, latest AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY seq DESC) = 1)"


@query(f"WITH {_LATEST} SELECT report_id, seq, status, esg_flag FROM latest")
def ledger_latest(spark, d):
    return ledger.latest(t.ledger(spark, d)).select("report_id", "seq", "status", "esg_flag")


@query(f"WITH {_LATEST} SELECT count(*) AS n, CAST(coalesce(sum(coalesce(esg_flag, 0)), 0) AS BIGINT) AS hits FROM latest WHERE status IN ('ok', 'skip')")
def ledger_success(spark, d):
    return ledger.anchor_hits(t.ledger(spark, d))


@query(f"WITH {LEDGER} SELECT status, count(*) AS n FROM ledger GROUP BY status")
def ledger_rollup(spark, d):
    return ledger.rollup(t.ledger(spark, d))


@query(f"WITH {_LATEST} SELECT CAST(c_custkey AS BIGINT) AS report_id, status AS ledger_status, CAST(coalesce(esg_flag, 0) AS INTEGER) AS esg_flag FROM customer LEFT JOIN latest ON c_custkey = report_id")
def ledger_enrich(spark, d):
    reports = table(spark, d, "customer").select(F.col("c_custkey").alias("report_id"))
    entries = t.ledger(spark, d).withColumn("file", F.lit(None).cast("string"))
    return ledger.enrich(reports, entries).select("report_id", "ledger_status", "esg_flag")


@query(f"""WITH {LEDGER}, r AS (SELECT seq, report_id, count(*) OVER w AS n, CAST(sum(CAST(status = 'ok' AS INTEGER)) OVER w AS BIGINT) AS n_ok, CAST(sum(CAST(status = 'skip' AS INTEGER)) OVER w AS BIGINT) AS n_skip,
  CAST(sum(CAST(status = 'fail' AS INTEGER)) OVER w AS BIGINT) AS n_fail FROM ledger WINDOW w AS (PARTITION BY report_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT * FROM r WHERE n % 25 = 0""")
def ledger_progress(spark, d):
    return ledger.running(t.ledger(spark, d), by="report_id").select("seq", "report_id", "n", "n_ok", "n_skip", "n_fail")


@query(f"WITH {_LATEST} SELECT report_id, seq FROM latest WHERE status = 'fail'")
def ledger_failures(spark, d):
    return ledger.failures(t.ledger(spark, d)).select("report_id", "seq")


@query(f"""WITH {LEDGER} SELECT seq, report_id, CASE WHEN event_type = 'view' THEN 'skip' WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS status, round(CAST(round(n_bytes * 100) AS BIGINT) * 10000 / 1e6, 2) AS size_mb FROM ledger""")
def ledger_entries(spark, d):
    done = t.ledger(spark, d).select("seq", "report_id", (F.round(F.col("n_bytes") * 100).cast("bigint") * 10000).alias("n_bytes"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("existed"))
    return ledger.entry(done)


# --- evidence


_PHRASES = ["ESRS", "a sustainability statement.", "Total GHG emissions", "Gross Scope 1 GHG emissions", "Scope 1 to 3", "Scope 1 and 3", "Water consumption", "Energy consumption and mix", "Confirmed incidents of corruption", "confirmed incidents of corruption", "esrs", "Scope 1 and 2 and 3"]


def _phrased(spark, d):
    """Each page ends with one of twelve phrases, ten of which disclose something."""
    phrase = F.get(F.array(*(F.lit(p) for p in _PHRASES)), (F.col("page_id") % len(_PHRASES)).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat("html", F.lit(" "), phrase).alias("html"))


@query("SELECT page_id, CAST(page_id % 12 < 10 AS INTEGER) AS esg_flag FROM pages")
def anchor_flag(spark, d):
    return _phrased(spark, d).select("page_id", expr.has_anchor(F.col("html")).alias("esg_flag"))


@query(r"""SELECT doc_id, list_filter([CASE WHEN regexp_replace(coalesce(CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END, ''), '^\s+|\s+$', '', 'g') = '' THEN 'native_text_empty' END,
  CASE WHEN regexp_matches(text, '\S+ \| \S+ \| \S+') THEN 'table_candidate_detected' END], lambda x: x IS NOT NULL) AS quality_flags FROM documents""")
def page_flags(spark, d):
    text = F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", evidence.page_flags(text, F.col("text").rlike(evidence.TABLE_MARK)).alias("quality_flags"))


@query(r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS block_index, unnest(b) AS text FROM s)
SELECT * FROM x WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""")
def block_explode(spark, d):
    return evidence.blocks(table(spark, d, "documents"), "text", ("doc_id",))


@query(f"""WITH {FRAGMENTS} SELECT page_index, 'packet_' || substr(sha256('=r|=' || page_index || '|=full_harvest'), 1, 32) AS packet_id, count(*) AS n_fragments FROM fragments GROUP BY page_index""")
def packet_build(spark, d):
    p = evidence.packets(t.fragments(spark, d))
    return p.select("page_index", "packet_id", F.size("primary").cast("bigint").alias("n_fragments"))


@query(f"WITH {FRAGMENTS} SELECT page_index, string_agg(coalesce(text, ''), chr(10) ORDER BY block_index) AS text FROM fragments GROUP BY page_index")
def packet_text(spark, d):
    return evidence.packets(t.fragments(spark, d)).select("page_index", evidence.packet_text(F.col("primary")).alias("text"))


@query(f"""WITH {FRAGMENTS} SELECT page_index, substr(string_agg('[' || id || '] page=' || (page_index + 1) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY block_index), 1, 6000) AS prompt FROM fragments GROUP BY page_index""")
def packet_prompt(spark, d):
    return evidence.packets(t.fragments(spark, d)).select("page_index", evidence.packet_prompt(F.col("primary")).alias("prompt"))


@query(f"WITH {FRAGMENTS} SELECT page_index, list(id ORDER BY block_index) AS refs FROM fragments GROUP BY page_index")
def packet_refs(spark, d):
    return evidence.packets(t.fragments(spark, d)).select("page_index", evidence.packet_refs(F.col("primary")).alias("refs"))


@query(f"""WITH {FRAGMENTS}, p AS (SELECT DISTINCT page_index, page_index % 7 AS report_id FROM fragments), n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page_index) AS k FROM p)
SELECT report_id, page_index FROM n WHERE k > 2 AND k <= 12""")
def packet_slice(spark, d):
    p = t.fragments(spark, d).select("page_index", (F.col("page_index") % 7).alias("report_id")).distinct()
    return evidence.slice_packets(p, 2, 50)


@query("""WITH s AS (SELECT unnest(string_split(lower(text), '. ')) AS keyword FROM benchmark), k AS (SELECT DISTINCT keyword FROM s WHERE len(trim(keyword)) >= 20)
SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM k WHERE contains(lower(text), keyword))""")
def targeted_recall(spark, d):
    """Documents that hold a sentence of the benchmark."""
    sentences = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("keyword")).where(F.length(F.trim("keyword")) >= 20)
    return evidence.recall_by_table(table(spark, d, "documents").select("doc_id", "text"), sentences).select("doc_id")


_CITED = f"""{FRAGMENTS}, packet AS (SELECT page_index, list(id ORDER BY block_index) AS refs FROM fragments GROUP BY page_index),
cited AS (SELECT page_index, refs, CASE WHEN page_index % 5 = 0 THEN NULL WHEN page_index % 5 = 1 THEN [refs[1], 'ev_x'] WHEN page_index % 5 = 2 THEN [refs[1], refs[1]] ELSE refs END AS ids FROM packet)"""


def _cited(spark, d):
    p = evidence.packets(t.fragments(spark, d)).select("page_index", evidence.packet_refs(F.col("primary")).alias("refs"))
    k, first = F.col("page_index") % 5, F.get("refs", F.lit(0))
    return p.withColumn("ids", F.when(k == 0, None).when(k == 1, F.array(first, F.lit("ev_x"))).when(k == 2, F.array(first, first)).otherwise(F.col("refs")))


@query(f"WITH {_CITED} SELECT page_index, list_filter(coalesce(ids, []), lambda x: list_contains(refs, x)) AS kept FROM cited")
def evidence_filter(spark, d):
    return _cited(spark, d).select("page_index", evidence.allowed_only(F.col("ids"), F.col("refs")).alias("kept"))


@query(f"WITH {_CITED} SELECT page_index, ids IS NOT NULL AND len(ids) > 0 AND len(list_filter(ids, lambda x: NOT list_contains(refs, x))) = 0 AS supported FROM cited")
def evidence_verify(spark, d):
    return _cited(spark, d).select("page_index", evidence.supported(F.col("ids"), F.col("refs")).alias("supported"))


@query(f"WITH {_CITED} SELECT CAST(page_index AS VARCHAR) AS disclosure_id FROM cited WHERE ids IS NOT NULL AND len(list_filter(ids, lambda x: NOT list_contains(refs, x))) = 0")
def publishable(spark, d):
    packets = evidence.packets(t.fragments(spark, d))
    rows = _cited(spark, d).select(F.col("page_index").cast("string").alias("disclosure_id"), F.lit("r").alias("report_id"), F.col("ids").alias("evidence_ids"))
    return evidence.publishable(rows, packets).select("disclosure_id")


# --- candidates


@query(r"""SELECT doc_id, substr(text, 1, 4000) AS raw_text, 'qualitative' AS disclosure_type, ['local_baseline_only', 'requires_cloud_extraction'] AS quality_flags FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""")
def baseline_harvest(spark, d):
    rows = candidates.baseline(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), F.array(F.col("doc_id").cast("string")))
    return rows.select("doc_id", "raw_text", "disclosure_type", "quality_flags")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


_ANSWER = """CASE event_id % 6 WHEN 0 THEN 'Here: ```json' || chr(10) || props || chr(10) || '``` ok' WHEN 1 THEN props WHEN 2 THEN 'so ' || props || ' there' WHEN 3 THEN '[' || props || ']' WHEN 4 THEN 'nothing {' ELSE '{"k": ' END"""


def _answer():
    p = F.col("props")
    k = F.col("event_id") % 6
    return (
        F.when(k == 0, F.concat(F.lit("Here: ```json\n"), p, F.lit("\n``` ok"))).when(k == 1, p).when(k == 2, F.concat(F.lit("so "), p, F.lit(" there"))).when(k == 3, F.concat(F.lit("["), p, F.lit("]")))
        .when(k == 4, F.lit("nothing {")).otherwise(F.lit('{"k": '))
    )


@query(f"""WITH a AS (SELECT event_id, props, {_ANSWER} AS content FROM events)
SELECT event_id, CASE event_id % 6 WHEN 3 THEN '[' || props || ']' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE props END AS json FROM a""")
def tolerant_json(spark, d):
    return table(spark, d, "events").select("event_id", candidates.json_text(_answer()).alias("json"))


@query("""WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CAST(0 AS INTEGER) AS item_index, CASE WHEN event_type = 'error' THEN 'risk' ELSE 'qualitative' END AS disclosure_type,
  CASE WHEN k % 2 = 0 THEN 'L' || k ELSE 'cloud_disclosure_1' END AS raw_label,
  CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'L' || k ELSE 'cloud_disclosure_1' END ELSE 'summary ' || k END AS raw_text,
  CASE WHEN k % 5 = 0 THEN [] ELSE ['u' || user_id] END AS evidence_ids,
  list_filter(['cloud_candidate', CASE WHEN k % 5 = 0 THEN 'missing_valid_evidence_id' END, CASE WHEN event_type <> 'error' THEN 'normalized_disclosure_type:' || event_type END,
    CASE WHEN k % 3 = 0 THEN 'missing_raw_text' END], lambda x: x IS NOT NULL) AS quality_flags FROM e""")
def candidate_parse(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.when(F.col("event_type") == "error", "Risk").otherwise(F.col("event_type"))
    ids = F.when(k % 5 == 0, F.lit('["nobody"]')).otherwise(F.concat(F.lit('["u'), F.col("user_id").cast("string"), F.lit('", "other"]')))
    item = F.concat(
        F.lit('{"disclosures": [{"label": "'), F.when(k % 2 == 0, F.concat(F.lit("L"), k.cast("string"))).otherwise(""), F.lit('", "summary": "'),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("summary "), k.cast("string"))), F.lit('", "disclosure_type": "'), kind, F.lit('", "evidence_ids": '), ids, F.lit("}]}"),
    )
    content = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).otherwise(item)
    response = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    rows = table(spark, d, "events").withColumn("response", response).withColumn("allowed", F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    out = candidates.parse(rows, F.col("response"), F.col("allowed"), ["event_id"])
    return out.select("event_id", "item_index", "disclosure_type", "raw_label", "raw_text", "evidence_ids", "quality_flags")


@query(f"""SELECT event_id, json_extract_string(props, '$.k') AS k, '{BASE}/f/' || json_extract_string(props, '$.k') AS package_url FROM events""")
def scan_props_map(spark, d):
    whole = F.concat(F.lit('{"package_url": "/f/'), F.get_json_object("props", "$.k"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    rows = index.all_attributes(table(spark, d, "events").withColumn("json", whole), "json", BASE, "map")
    return rows.select("event_id", F.col("map")["k"].alias("k"), F.col("map")["package_url"].alias("package_url"))


@query("""SELECT doc_id, list_filter(['before', CASE WHEN quality IS NULL THEN 'cloud_result_unparsed:' || doc_id END, CASE WHEN coalesce(toxic, 0) = 0 THEN 'cloud_coordinates_missing:' || doc_id END], lambda x: x IS NOT NULL) AS conflicts
FROM documents LEFT JOIN labels USING (doc_id)""")
def fusion_flags(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", candidates.fusion_flags(F.array(F.lit("before")), F.col("doc_id").cast("string"), F.col("quality"), F.col("toxic") == 1).alias("conflicts"))


@query("""SELECT p_partkey AS disclosure_id, CAST(p_retailprice AS DOUBLE) AS value, 'EUR' AS unit FROM part""")
def observation_parse(spark, d):
    text = F.concat(F.lit("costs "), F.format_number("p_retailprice", 2), F.lit(" EUR each"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("disclosure_id"), F.lit("quantitative").alias("disclosure_type"), text.alias("raw_text"), F.array(F.lit("e")).alias("evidence_ids"))
    return candidates.observations(rows).select("disclosure_id", "value", "unit")


# --- routing


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_type = 'PROMO' THEN ['text', 'image'] ELSE ['text'] END AS input_modalities,
  CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS BIGINT) * 1000 WHEN p_brand LIKE '%1' THEN 1000000 WHEN p_brand LIKE '%2' THEN 262144 ELSE 32768 END AS context_length,
  p_size % 3 = 0 AS supports_functions, p_brand LIKE '%3' AS supports_reasoning, CASE WHEN p_size = 7 THEN '2025-01-01' END AS retirement_at FROM part""")
def model_capabilities(spark, d):
    # a small file with long work on each row: all cores get a share of it
    p = table(spark, d, "part").repartition(spark.sparkContext.defaultParallelism)
    name = F.concat(
        F.when(F.col("p_brand").endswith("1"), "longcat").when(F.col("p_brand").endswith("2"), "kimi").when(F.col("p_brand").endswith("3"), "thinking").otherwise("plain"),
        F.when(F.col("p_type") == "PROMO", "-vl").otherwise(""),
    )
    record = F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("id"), name.alias("name"), F.when(F.col("p_size") % 5 == 0, F.struct((F.col("p_size") * 1000).alias("context_length"))).alias("model_constraints"),
            F.struct(F.struct((F.col("p_size") % 3 == 0).alias("supported")).alias("function_calling")).alias("architecture"), F.when(F.col("p_size") == 7, "2025-01-01").otherwise("").alias("retirement_at"),
        )
    )
    return routing.capabilities(p.select(record.alias("record"))).select("id", "input_modalities", "context_length", "supports_functions", "supports_reasoning", "retirement_at")


_ABLE = "SELECT id FROM models WHERE NOT retired AND {} ORDER BY context_length DESC, supports_functions DESC, ordinal LIMIT 1"


@query(f"WITH {MODELS} SELECT (SELECT id FROM ({_ABLE.format('image AND supports_schema AND context_length >= 128000')})) AS model_id")
def model_select(spark, d):
    return routing.select(t.models(spark, d), image=True, schema=True, context=128_000)


@query(f"""WITH {MODELS}, able AS (SELECT (SELECT id FROM ({_ABLE.format('image AND context_length >= 32000')})) AS image, (SELECT id FROM ({_ABLE.format('supports_schema AND context_length >= 64000')})) AS schema_,
  (SELECT id FROM ({_ABLE.format('context_length >= 128000')})) AS long_, (SELECT id FROM ({_ABLE.format('context_length >= 128000 AND supports_reasoning')})) AS reasoning)
SELECT 'vision_ocr' AS task, image AS model_id, true AS in_registry, 'requires_image' AS reason FROM able
UNION ALL SELECT 'table_vision_extract', image, true, 'requires_image' FROM able UNION ALL SELECT 'visual_verification', image, true, 'requires_image' FROM able
UNION ALL SELECT 'structured_extract', '17', true, 'preferred_available_model' FROM able UNION ALL SELECT 'verification', schema_, true, 'requires_schema' FROM able
UNION ALL SELECT 'qualitative_summarization', long_, true, 'requires_long_context_or_reasoning' FROM able UNION ALL SELECT 'long_context_understanding', long_, true, 'requires_long_context_or_reasoning' FROM able
UNION ALL SELECT 'mapping_review', 'elsewhere', false, 'explicit_env_model_not_in_registry' FROM able
UNION ALL SELECT 'page_classification', '5', true, 'explicit_env_model' FROM able""")
def model_router(spark, d):
    tasks = routing.decision_table(spark, {"fast": "5", "reasoning": "elsewhere"})
    preferences = routing.preference_table(spark, {"nowhere": {"structured_extract": 1}, "17": {"structured_extract": 2}, "4": {"structured_extract": 3}})
    return routing.route(t.models(spark, d), tasks, preferences)


# --- store


def _children(spark, d):
    n, c, s = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "supplier")
    reports = n.select(F.col("n_nationkey").alias("report_id"), F.col("n_name").alias("created_at"))
    packets = c.select(F.col("c_nationkey").alias("report_id"), F.col("c_custkey").alias("packet_id"))
    disclosures = s.select(F.col("s_nationkey").alias("report_id"), F.col("s_suppkey").alias("disclosure_id"))
    results = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("report_id"), F.col("c_custkey").alias("request_id"), F.col("c_mktsegment").alias("model_id"))
    return reports, packets, disclosures, results


@query("""SELECT n_nationkey AS report_id, n_name AS created_at, count(DISTINCT c.c_custkey) AS packet_count, count(DISTINCT s_suppkey) AS disclosure_count, count(DISTINCT r.c_custkey) AS result_count,
  list_sort(coalesce(list(DISTINCT r.c_mktsegment) FILTER (WHERE r.c_mktsegment IS NOT NULL), [])) AS models
FROM nation LEFT JOIN customer c ON c.c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) r ON r.c_custkey = c.c_custkey GROUP BY ALL""")
def report_listing(spark, d):
    return store.listing(*_children(spark, d))


@query("""SELECT n_nationkey AS report_id, n_name AS created_at, (SELECT coalesce(list(c_custkey ORDER BY c_custkey), []) FROM customer WHERE c_nationkey = n_nationkey) AS packet_ids,
  (SELECT coalesce(list(s_suppkey ORDER BY s_suppkey), []) FROM supplier WHERE s_nationkey = n_nationkey) AS disclosure_ids FROM nation""")
def report_detail(spark, d):
    reports, packets, disclosures, _ = _children(spark, d)
    whole = store.detail(reports, {"p": (packets, ["packet_id"]), "s": (disclosures, ["disclosure_id"])})
    return whole.select("report_id", "created_at", F.col("p.packet_id").alias("packet_ids"), F.col("s.disclosure_id").alias("disclosure_ids"))


@query(f"WITH {FRAGMENTS} SELECT page_index % 7 AS report_id, count(DISTINCT page_index) AS packets, count(*) AS fragments, count(DISTINCT kind) AS kinds FROM fragments GROUP BY 1")
def benchmark_cases(spark, d):
    return evidence.cases(t.fragments(spark, d).withColumn("report_id", F.col("page_index") % 7))


@query("""SELECT code, regexp_extract(code, '^[A-Z]+[0-9]+') AS topic, unit FROM (VALUES ('G1', NULL), ('S1', NULL), ('E3-4', 'm3'), ('E1-8', NULL), ('E1-7', NULL), ('E1-6', 'tCO2e'), ('E1-5', 'MWh')) v(code, unit)""")
def vocab_topics(spark, d):
    return schemas.datapoints(spark).select("code", "topic", "unit")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return store.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("""SELECT user_id, props, event_id FROM events WHERE event_type <> 'purchase' AND (user_id, props) NOT IN (SELECT (user_id, props) FROM events WHERE event_type = 'purchase')
QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1""")
def insert_ignore(spark, d):
    e = table(spark, d, "events")
    new, old = (e.where(w).select("user_id", "props", "event_id") for w in ("event_type <> 'purchase'", "event_type = 'purchase'"))
    return store.insert_ignore(old, new, ["user_id", "props"], "event_id")


@query("""SELECT user_id, event_id FROM events e WHERE event_id % 2 = 1 UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1)""")
def replace_reports(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return store.replace_reports(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id")


@query(f"""WITH {PRIMARY}, {CUSTOMERS} SELECT lei, c.entity_name, c.country FROM (SELECT DISTINCT lei FROM primary_filings) JOIN customers c USING (lei)""")
def entity_dimension(spark, d):
    named = index.primary_index(t.filings(spark, d)).join(t.customers(spark, d), "lei", "left")
    return index.entities_of(named)


# --- streaming: the stream is run to its end, and what it leaves must be what a batch over the same entries gives


def _drained(frame, mode: str) -> DataFrame:
    spark = frame.sparkSession
    folder = work_folder(spark, "drained")
    spark.createDataFrame([], frame.schema).write.parquet(f"{folder}/out")
    writer = frame.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    writer.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _events_stream(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    status = F.when(F.col("event_type").isin("purchase", "click"), "ok").when(F.col("event_type") == "view", "skip").otherwise("fail")
    return stream.select(F.col("event_id").alias("seq"), F.col("user_id").alias("report_id"), status.alias("status"), (F.col("value") > 50).cast("int").alias("esg_flag"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"WITH {_LATEST} SELECT report_id, seq, status, esg_flag FROM latest")
def stream_ledger_latest(spark, d):
    out = _drained(stream_ledger.latest(_events_stream(spark, d).drop("ts")), "complete")
    return out.select("report_id", "entry.seq", "entry.status", "entry.esg_flag")


@query(f"WITH {LEDGER} SELECT status, count(*) AS n FROM ledger GROUP BY status")
def stream_ledger_rollup(spark, d):
    return _drained(stream_ledger.counters(_events_stream(spark, d)), "complete")


from . import surface  # noqa: E402, F401 - registers its queries

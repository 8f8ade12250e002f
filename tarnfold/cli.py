"""Command line: python -m tarnfold.cli COMMAND --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workflow
from .functions import expr
from .operators import coverage, index, ledger, quality, routing
from .sources import api, archives, files
from .sources.report_store import ReportStore


def session() -> SparkSession:
    return SparkSession.builder.appName("tarnfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(df: DataFrame) -> None:
    """Every row, one partition at a time."""
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(row["j"])


def _wanted(spark: SparkSession, a) -> DataFrame:
    rows = index.select_filings(files.read_index(spark, a.index), getattr(a, "country", None), a.years and [int(y) for y in a.years.split(",")], limit=a.limit)
    return rows.withColumn("file", expr.package_name(F.col("lei"), F.col("period_end"), F.col("sha256")))


def cmd_index(spark: SparkSession, a) -> int:
    """Raw filings (CSV) to the primary index, coverage and an audit; fails if an invariant does."""
    raw = files.read_index(spark, a.raw, files.schemas.RAW_FILING)
    primary = index.primary_index(raw, a.strict)
    files.write_table(primary, f"{a.out}/primary")
    primary = spark.read.parquet(f"{a.out}/primary")
    files.write_table(index.entities_of(primary), f"{a.out}/entity")
    files.write_csv(coverage.view(primary.withColumn("report_year", expr.report_year(F.col("period_end")))), f"{a.out}/coverage")
    checks = quality.index_audit(raw, index.dedup_content(raw, a.strict), primary, index.entities_of(primary)).collect()
    for c in checks:
        print("PASS" if c.passed else "FAIL", c.check_name, c.violations)
    return int(not all(c.passed for c in checks))


def cmd_plan(spark: SparkSession, a) -> int:
    _show(ledger.plan(_wanted(spark, a), files.inventory(spark, a.packages), "file"))
    return 0


def cmd_verify(spark: SparkSession, a) -> int:
    """Files against the index: counts, and the list of bad ones."""
    have = archives.packages(spark, a.packages)
    checked = quality.integrity(_wanted(spark, a).withColumnRenamed("sha256", "expected_sha").join(have, "file", "left"))
    files.write_table(checked.where("bad OR missing").select("file", "missing", "sha_ok", "bad"), f"{a.out}/verify")
    row = quality.integrity_counts(checked).first()
    print(row.asDict())
    return int(row["bad"] > 0)


def cmd_inspect(spark: SparkSession, a) -> int:
    _show(archives.documents(spark, a.documents).select("report_id", "page_index", F.length("native_text").alias("n_chars"), "quality_flags"))
    return 0


def cmd_run_local(spark: SparkSession, a) -> int:
    pages = archives.documents(spark, a.documents)
    ReportStore(spark, a.store).save_state(workflow.run_local(pages), pages.select("report_id", "sha256").distinct())
    return 0


def cmd_init_db(spark: SparkSession, a) -> int:
    """An empty store, so that readers find every table."""
    store = ReportStore(spark, a.store)
    for name in ("reports", "pages", "packets", "disclosures", "results"):
        store.save(name, store.read(name))
    return 0


def cmd_run_cloud(spark: SparkSession, a) -> int:
    pages = archives.documents(spark, a.documents)
    state = workflow.run_cloud(pages, api.http_completer(a.url, a.token), a.model, f"{a.store}/answers", a.start, a.most)
    ReportStore(spark, a.store).save_state(state, pages.select("report_id", "sha256").distinct())
    return 0


def cmd_refresh_models(spark: SparkSession, a) -> int:
    print(api.refresh_models(api.http_fetch, a.url, a.models))
    return 0


def cmd_crawl(spark: SparkSession, a) -> int:
    """Raw filings from the paginated API, as CSV for index."""
    rows = api.filings_from_api(spark, api.http_fetch, a.base, a.country and a.country.split(","), a.pages)
    files.write_csv(rows.drop("complete"), a.out)
    return 0


def cmd_download(spark: SparkSession, a) -> int:
    """Packages that are wanted and not there yet; outcomes are appended to the ledger, and a second run goes on from it."""
    todo = ledger.pending(_wanted(spark, a), files.inventory(spark, a.packages), "file")
    outcomes = api.download(todo.repartition(a.workers or 4), api.http_fetch, api.folder_store(a.packages)).withColumn("seq", F.unix_micros(F.current_timestamp()))
    columns = [F.col(c) if c in (*outcomes.columns, "status", "size_mb") else F.lit(None).cast(k).alias(c) for c, k in spark.createDataFrame([], files.schemas.LEDGER).dtypes]
    files.append_ledger(ledger.entry(outcomes).select(*columns), a.ledger)
    return int(files.write_failures(files.read_ledger(spark, a.ledger), f"{a.ledger}_failures"))


def cmd_list_reports(spark: SparkSession, a) -> int:
    _show(ReportStore(spark, a.store).listing())
    return 0


def cmd_report(spark: SparkSession, a) -> int:
    _show(ReportStore(spark, a.store).detail(a.report))
    return 0


def cmd_models(spark: SparkSession, a) -> int:
    _show(routing.capabilities(files.read_models(spark, a.models)))
    return 0


def cmd_assessment(spark: SparkSession, a) -> int:
    _show(routing.assessment(spark))
    return 0


def cmd_select_model(spark: SparkSession, a) -> int:
    listed = files.read_models(spark, a.models)
    models = routing.capabilities(listed).join(listed.select(F.get_json_object("record", "$.id").alias("id"), "ordinal"), "id")
    pins = {k: v for k, v in (("text", a.text), ("vision", a.vision), ("reasoning", a.reasoning), ("fast", a.fast)) if v}
    routed = routing.route(models, routing.decision_table(spark, pins), routing.preference_table(spark))
    _show(routed.where(F.col("task") == a.task) if a.task else routed)
    return 0


def cmd_sql(spark: SparkSession, a) -> int:
    """Any SQL over Parquet tables, each as a view of its folder's name."""
    for path in a.table:
        spark.read.parquet(path).createOrReplaceTempView(path.rstrip("/").rpartition("/")[2].partition(".")[0])
    _show(spark.sql(a.query))
    return 0


def cmd_serve(spark: SparkSession, a) -> int:
    from .server import serve

    serve(spark, ReportStore(spark, a.store), a.host, a.port)
    return 0


_ARGUMENTS = {
    "index": ("raw", "out", "--strict"), "plan": ("index", "packages", "--years", "--country", "--limit"), "verify": ("index", "packages", "out", "--years", "--country", "--limit"),
    "crawl": ("base", "out", "--country", "--pages"), "download": ("index", "packages", "ledger", "--years", "--country", "--limit", "--workers"), "init-db": ("store",),
    "run-cloud": ("documents", "store", "url", "model", "--token", "--start", "--most"), "refresh-models": ("url", "models"), "inspect": ("documents",), "run-local": ("documents", "store"), "list-reports": ("store",), "report": ("store", "report"), "models": ("models",), "assessment": (),
    "select-model": ("models", "--task", "--text", "--vision", "--reasoning", "--fast"), "sql": ("query", "--table"), "serve": ("store", "--host", "--port"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnfold")
    commands = p.add_subparsers(dest="command", required=True)
    for name, arguments in _ARGUMENTS.items():
        c = commands.add_parser(name)
        for x in arguments:
            kind = {"--strict": {"action": "store_true"}, "--limit": {"type": int}, "--pages": {"type": int}, "--workers": {"type": int}, "--start": {"type": int, "default": 0}, "--most": {"type": int, "default": 10}, "--port": {"type": int, "default": 8765}, "--host": {"default": "127.0.0.1"}, "--table": {"action": "append", "default": []}}
            c.add_argument(x, **kind.get(x, {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return globals()[f"cmd_{a.command.replace('-', '_')}"](spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())

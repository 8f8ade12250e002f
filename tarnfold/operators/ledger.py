"""The processing ledger: append-only entries, of which the latest for each item counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKAGE_MB = 15


def latest(ledger: DataFrame, key: str = "report_id", seq: str = "seq") -> DataFrame:
    """The last entry of each item. One aggregation with a map-side part; rows are not sorted."""
    rest = [c for c in ledger.columns if c != key]
    last = ledger.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.select(key, "_last.*").select(*ledger.columns)


def successes(ledger: DataFrame, statuses: tuple[str, ...] = ("ok", "skip")) -> DataFrame:
    return ledger.where(F.col("status").isin(*statuses))


def rollup(ledger: DataFrame) -> DataFrame:
    """How many entries have each status."""
    return ledger.groupBy("status").agg(F.count("*").alias("n"))


def anchor_hits(ledger: DataFrame, flag: str = "esg_flag") -> DataFrame:
    """Of the items that succeeded last: how many, and how many hold a disclosure phrase."""
    return successes(latest(ledger)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(flag, F.lit(0))), F.lit(0)).cast("bigint").alias("hits"))


def enrich(reports: DataFrame, ledger: DataFrame) -> DataFrame:
    """reports with their last ledger entry's flag and file; the flag is 0 where there is none."""
    entry = latest(ledger).select("report_id", F.col("esg_flag").alias("_flag"), F.col("file").alias("ledger_file"), F.col("status").alias("ledger_status"))
    return reports.drop("esg_flag").join(entry, "report_id", "left").withColumn("esg_flag", F.coalesce("_flag", F.lit(0))).drop("_flag")


def pending(wanted: DataFrame, inventory: DataFrame, key: str, size: str | None = "size") -> DataFrame:
    """Rows of wanted that have no file, or only an empty one: what a rerun has to do."""
    have = inventory.where(F.col(size) > 0) if size else inventory
    return wanted.join(have.select(key), key, "left_anti")


def plan(wanted: DataFrame, inventory: DataFrame, key: str, reserve: float = 1.2) -> DataFrame:
    """matched, have, todo, and the volume that is left, with and without a reserve."""
    have = inventory.where("size > 0").select(key, F.lit(1).alias("_have")).distinct()
    counted = wanted.join(have, key, "left").agg(F.count("*").alias("matched"), F.count("_have").alias("have"))
    todo = counted.withColumn("todo", F.col("matched") - F.col("have"))
    return todo.withColumn("todo_gb", F.col("todo") * PACKAGE_MB / 1024).withColumn("needed_gb", F.col("todo_gb") * reserve)


def running(ledger: DataFrame, seq: str = "seq", every: int = 25, by: str | None = None) -> DataFrame:
    """Counters after each `every` entries, in the order of seq (within `by`, which a large ledger should name)."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.sum((F.col("status") == s).cast("bigint")).over(w).alias(f"n_{s}") for s in ("ok", "skip", "fail")]
    out = ledger.select("*", F.count("*").over(w).alias("n"), *counts)
    return out.where(F.col("n") % every == 0)


def entry(done: DataFrame) -> DataFrame:
    """Ledger rows from outcomes (…, n_bytes, ok, existed): status and size."""
    status = F.when(F.col("existed"), "skip").when(F.col("ok"), "ok").otherwise("fail")
    return done.withColumn("status", status).withColumn("size_mb", F.round(F.col("n_bytes") / 1e6, 2)).drop("ok", "existed", "n_bytes")


def failures(ledger: DataFrame) -> DataFrame:
    return latest(ledger).where("status = 'fail'")

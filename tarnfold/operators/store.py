"""Keyed storage over plain tables: upsert, insert-ignore, listing and detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of old and new together the last row by seq of each key. No table format is needed: write it over the old table under a new name."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.select(*keys, "_last.*").select(*both.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The rows of new to append: the first of each key that old doesn't have. Rows with a NULL in the key are left out."""
    w = Window.partitionBy(*keys).orderBy(seq)
    first = new.dropna(subset=keys).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(old.select(*keys), keys, "left_anti")


def insert_strict(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new; any key that then occurs twice raises when the rows are read."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    return both.withColumn("_n", F.count("*").over(w)).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key")).cast("boolean")).otherwise(True)).drop("_n")


def replace_reports(old: DataFrame, new: DataFrame, key: str = "report_id") -> DataFrame:
    """All rows of the reports in new instead of those in old: nothing of an earlier run is left."""
    return other_reports(old, new.select(key).distinct(), key).unionByName(new, allowMissingColumns=True)


def other_reports(old: DataFrame, ids: DataFrame, key: str = "report_id") -> DataFrame:
    """The rows of old whose report isn't among ids; NULL is among none."""
    return old.join(ids, key, "left_anti")


def listing(reports: DataFrame, packets: DataFrame, disclosures: DataFrame, results: DataFrame, key: str = "report_id") -> DataFrame:
    """Reports with the number of their packets, disclosures and results. Each child is counted before the join, so that none multiplies another."""
    out = reports
    for child, ident, name in ((packets, "packet_id", "packet_count"), (disclosures, "disclosure_id", "disclosure_count"), (results, "request_id", "result_count")):
        counts = child.groupBy(key).agg(F.count_distinct(ident).alias(name))
        out = out.join(counts, key, "left").fillna(0, [name])
    models = results.groupBy(key).agg(F.array_sort(F.collect_set("model_id")).alias("models"))
    out = out.join(models, key, "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))
    return out.orderBy(F.desc_nulls_last("created_at"), key) if "created_at" in out.columns else out.orderBy(key)


def detail(reports: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], ident=None, key: str = "report_id") -> DataFrame:
    """Reports (or the one named) with each child's rows as an array of structs, sorted by the child's columns in their order."""
    out = reports if ident is None else reports.where(F.col(key) == ident)
    for name, (child, columns) in children.items():
        child = child if ident is None else child.where(F.col(key) == ident)
        rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out

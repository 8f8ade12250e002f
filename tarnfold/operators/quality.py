"""Audits: a table of checks instead of constraints that nothing enforces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str], ignore_null: bool = False) -> DataFrame:
    """Key values that occur more than once, with their counts."""
    if ignore_null:
        df = df.dropna(subset=keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of child whose key is not in parent."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def outside(df: DataFrame, column: str, allowed: set[str]) -> DataFrame:
    """Rows with a value that is not in the vocabulary; NULL is no value."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(sorted(allowed)))


def check(df: DataFrame, name: str, violations: Column) -> DataFrame:
    """One row (name, violations, passed) from an aggregate."""
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("v")).select(F.lit(name).alias("check_name"), F.col("v").alias("violations"), (F.col("v") == 0).alias("passed"))


def repeated(name: str, df: DataFrame, *keys: str) -> DataFrame:
    """How many rows are beyond the first of their key; rows with a NULL in the key are ignored."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return check(df, name, F.count_if(whole) - F.count_distinct(*keys))


def audit(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def index_audit(raw: DataFrame, content: DataFrame, primary: DataFrame, entities: DataFrame) -> DataFrame:
    """The invariants of a loaded index. All but the look-up of entities come from a single aggregate over primary."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = primary.agg(
        (F.count_if(F.col("sha256") != "") - F.count_distinct(F.nullif("sha256", F.lit("")))).alias("hashes"),
        (F.count_if(F.col("lei").isNotNull() & F.col("period_end").isNotNull()) - F.count_distinct("lei", "period_end")).alias("periods"),
        total("n_versions").alias("versions"),
        total("n_raw").alias("raw"),
    )
    counts = [content.agg(F.count("*").alias("n_content")), raw.agg(F.count("*").alias("n_raw")), orphans(primary, entities, "lei").agg(F.count("*").alias("unknown"))]
    # each part is one row with columns of its own, so that the union's maxima put them side by side
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts, facts)
    one = one.agg(*(F.max(c).alias(c) for c in one.columns))
    found = {
        "content hash is unique": F.col("hashes"),
        "entity and period are unique": F.col("periods"),
        "every filing has an entity": F.col("unknown"),
        "versions add up to filings after content dedup": F.abs(F.col("versions") - F.col("n_content")),
        "raw counts add up to raw filings": F.abs(F.col("raw") - F.col("n_raw")),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("check_name"), v.cast("bigint").alias("violations"), (v == 0).alias("passed")) for name, v in found.items()))
    return one.select(F.inline(rows))


def quarantine(df: DataFrame, required: list[str], key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that lack a required column, or that repeat a key, are bad, with a reason; of a key the first by order is good."""
    from pyspark.sql import Window

    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in [*required, key])))
    w = Window.partitionBy(key, "_whole").orderBy(*order)
    looked = df.withColumn("_lacking", lacking).withColumn("_whole", F.size("_lacking") == 0)
    reason = F.when(~F.col("_whole"), F.array_join("_lacking", ", ")).when(F.row_number().over(w) > 1, F.lit(f"repeated {key}"))
    looked = looked.withColumn("reason", reason).drop("_lacking", "_whole")
    return looked.where("reason IS NULL").drop("reason"), looked.where("reason IS NOT NULL")


def integrity(files: DataFrame, expected: str = "expected_sha", actual: str = "actual_sha", zip_ok: str = "zip_ok", size: str = "size") -> DataFrame:
    """missing, sha_ok, and bad for each file. Without an expected hash any content is right."""
    want = F.nullif(F.lower(F.col(expected)), F.lit(""))
    missing = F.col(actual).isNull() | (F.coalesce(F.col(size), F.lit(0)) <= 0)
    sha_ok = want.isNull() | (want == F.lower(F.col(actual)))
    return files.withColumn("missing", missing).withColumn("sha_ok", F.coalesce(sha_ok, F.lit(False))).withColumn(
        "bad", ~F.col("missing") & ~(F.col("sha_ok") & F.coalesce(F.col(zip_ok), F.lit(False)))
    )


def integrity_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(~F.col("missing")).alias("checked"), F.count_if(F.col("bad")).alias("bad"), F.count_if(F.col("missing")).alias("missing"))

"""How the driver's tables stand in for filings, reports, pages, packets, ledgers and models; once for Spark, once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str):
    return F.col(c).cast("date").cast("string")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("api_id"),
        F.col("o_custkey").cast("string").alias("lei"),
        day("o_orderdate").alias("period_end"),
        expr.fiscal_year(day("o_orderdate")).alias("fiscal_year"),
        F.col("o_orderstatus").alias("report_type"),
        day("o_orderdate").alias("processed"),
        F.substring("o_orderpriority", 1, 1).alias("error_count"),
        F.sha2(F.concat_ws("|", "o_custkey", day("o_orderdate")), 256).alias("sha256"),
    )


FILINGS = """filings AS (
  SELECT o_orderkey AS api_id, CAST(o_custkey AS VARCHAR) AS lei, strftime(o_orderdate, '%Y-%m-%d') AS period_end,
    strftime(o_orderdate, '%Y') AS fiscal_year, o_orderstatus AS report_type, strftime(o_orderdate, '%Y-%m-%d') AS processed,
    substr(o_orderpriority, 1, 1) AS error_count, sha256(CAST(o_custkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS sha256
  FROM orders)"""
CONTENT = f"""{FILINGS}, content AS (
  SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY processed DESC NULLS LAST, api_id NULLS LAST) = 1)"""
PRIMARY = f"""{CONTENT}, primary_filings AS (
  SELECT *, count(api_id) OVER (PARTITION BY lei, period_end) AS n_versions FROM content
  QUALIFY row_number() OVER (PARTITION BY lei, period_end
    ORDER BY coalesce(TRY_CAST(error_count AS INTEGER), 9999), processed DESC NULLS LAST, api_id NULLS LAST) = 1)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lei, entity_name, country."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").cast("string").alias("lei"), F.col("c_name").alias("entity_name"), F.col("n_name").alias("country"))


CUSTOMERS = "customers AS (SELECT CAST(c_custkey AS VARCHAR) AS lei, c_name AS entity_name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each event; what a user did last is the state of the item."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("purchase", "click"), "ok").when(F.col("event_type") == "view", "skip").otherwise("fail")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("report_id"), status.alias("status"), F.col("value").alias("n_bytes"), (F.col("value") > 50).cast("int").alias("esg_flag"), "event_type", "props",
    )


LEDGER = """ledger AS (
  SELECT event_id AS seq, user_id AS report_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'ok' WHEN event_type = 'view' THEN 'skip' ELSE 'fail' END AS status,
    value AS n_bytes, CAST(value > 50 AS INTEGER) AS esg_flag, event_type, props FROM events)"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a page, its turns are fragments."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.lit("r").alias("report_id"), F.col("conv_id").alias("page_index"), F.col("turn").alias("block_index"), F.concat(F.lit("ev_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("kind"), "text",
    )


FRAGMENTS = "fragments AS (SELECT conv_id AS page_index, turn AS block_index, 'ev_' || conv_id || '_' || turn AS id, role AS kind, text FROM conversations)"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_partkey").alias("ordinal"),
        (F.col("p_size") * 4000).cast("bigint").alias("context_length"),
        F.when((F.col("p_type") == "PROMO"), F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text"))).alias("input_modalities"),
        F.col("p_brand").endswith("1").alias("supports_schema"),
        F.col("p_brand").endswith("2").alias("supports_reasoning"),
        (F.col("p_size") % 2 == 0).alias("supports_functions"),
        F.when(F.col("p_retailprice") > 990, "2024-01-01").alias("retirement_at"),
    )


MODELS = """models AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ordinal, CAST(p_size * 4000 AS BIGINT) AS context_length, p_type = 'PROMO' AS image, p_brand LIKE '%1' AS supports_schema,
    p_brand LIKE '%2' AS supports_reasoning, p_size % 2 = 0 AS supports_functions, p_retailprice > 990 AS retired FROM part)"""

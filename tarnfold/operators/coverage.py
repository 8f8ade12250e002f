"""Coverage of entities and years: pivots, rates, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "未知"


def by_year_and_type(filings: DataFrame, types: list[str], year: str = "fiscal_year", kind: str = "report_type", total: str = "total") -> DataFrame:
    """Counts by year, a column for each type, and their sum. Rows without a year or type don't count."""
    known = filings.where(F.col(year).isNotNull() & F.col(kind).isNotNull())
    wide = known.groupBy(year).pivot(kind, types).agg(F.count(F.lit(1))).fillna(0, types)
    return wide.withColumn(total, _sum(types)).orderBy(year)


def by_country_and_year(filings: DataFrame, years: list[str], country: str = "country", year: str = "fiscal_year", total: str = "total") -> DataFrame:
    """Counts by country, a column for each year and one for none, the largest total first."""
    filled = filings.where(F.col(country).isNotNull()).withColumn(year, F.coalesce(F.col(year).cast("string"), F.lit(UNKNOWN)))
    wide = filled.groupBy(country).pivot(year, [*years, UNKNOWN]).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumn(total, _sum([*years, UNKNOWN])).orderBy(F.desc(total), country)


def _sum(columns: list[str]) -> Column:
    out = F.lit(0).cast("bigint")
    for c in columns:
        out = out + F.col(f"`{c}`")
    return out


def view(filings: DataFrame, country: str = "country", year: str = "report_year") -> DataFrame:
    """Counts by (country, year), NULL groups included."""
    return filings.groupBy(country, year).agg(F.count("*").alias("collected"))


def entity_count(filings: DataFrame, key: str = "lei") -> DataFrame:
    """How many distinct non-empty entities there are."""
    return filings.agg(F.count_distinct(F.nullif(F.col(key), F.lit(""))).alias("entities"))


def rate(collected: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """collected and expected side by side for every key of either, and their ratio where it has one."""
    both = collected.join(expected, keys, "full_outer")
    y, x = F.coalesce("collected", F.lit(0)), F.coalesce("expected", F.lit(0))
    return both.select(*keys, y.alias("collected"), x.alias("expected"), F.when(x > 0, y / x).alias("rate"))


def gaps(disclosed: DataFrame, key: str = "lei", year: str = "fiscal_year", cutoff: int | None = None) -> DataFrame:
    """Years without a filing: strictly between an entity's first and last ("interrupted"), or after its last up to cutoff ("until_cutoff")."""
    span = disclosed.groupBy(key).agg(F.min(year).alias("t1"), F.max(year).alias("t2"), F.collect_set(year).alias("have"))
    last = F.col("t2") if cutoff is None else F.greatest("t2", F.lit(cutoff))
    missing = F.array_except(F.sequence("t1", last), "have")
    out = span.select(key, "t1", "t2", F.explode(missing).alias("missing_year"))
    return out.withColumn("kind", F.when(F.col("missing_year") < F.col("t2"), "interrupted").otherwise("until_cutoff"))


def forecast(rates: DataFrame, outlook: DataFrame, keys: list[str]) -> DataFrame:
    """Expected filings: the rate seen so far times the number of entities that are due."""
    return rates.join(outlook, keys, "left").withColumn("forecast", F.coalesce("rate", F.lit(0.0)) * F.coalesce("due", F.lit(0)))

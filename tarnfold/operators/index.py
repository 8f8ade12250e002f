"""From raw filing metadata to the primary index: projection, entities, two-stage dedup, surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

NO_COUNT = 9999


def flatten_page(pages: DataFrame, base_url: str) -> DataFrame:
    """Rows of RAW_FILING from API pages with columns data and included; the entity join stays within a page."""
    entity = F.filter("included", lambda e: (e["type"] == "entity") & (e["id"] == F.col("item.relationships.entity.data.id")))
    rows = pages.select(F.explode("data").alias("item"), "included").withColumn("entity", F.get(entity, F.lit(0)))
    a = lambda name: F.col(f"item.attributes.{name}")
    parts = expr.filing_id_parts(a("fxo_id"))
    return rows.select(
        F.col("item.id").alias("api_id"),
        a("fxo_id").alias("fxo_id"),
        expr.lei_of(F.col("entity.attributes.identifier"), a("fxo_id")).alias("lei"),
        F.col("entity.attributes.name").alias("entity_name"),
        expr.first_filled(a("country"), parts["country"]).alias("country"),
        parts["report_type"].alias("report_type"),
        parts["seq"].alias("seq"),
        a("period_end").alias("period_end"),
        expr.fiscal_year(a("period_end")).alias("fiscal_year"),
        expr.hash_of(a("sha256")).alias("sha256"),
        *(a(c).cast("string").alias(c) for c in ("processed", "date_added", "error_count", "inconsistency_count", "warning_count")),
        *(expr.absolute_url(a(c), base_url).alias(c) for c in ("package_url", "json_url", "viewer_url")),
    )


def all_attributes(rows: DataFrame, json_col: str, base_url: str, to: str = "props") -> DataFrame:
    """Every attribute of a JSON object as map<string,string>; values under keys that name a URL become absolute."""
    props = F.from_json(json_col, "map<string,string>")
    fixed = F.transform_values(props, lambda k, v: F.when(F.lower(k).contains("url"), expr.absolute_url(v, base_url)).otherwise(v))
    return rows.withColumn(to, fixed)


def with_entities(filings: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """filings with their entity's columns, NULL where it is unknown. Spark broadcasts entities if they are small."""
    return filings.join(entities, key, "left")


def select_filings(filings: DataFrame, country: str | None = None, years: list[int] | None = None, need_url: bool = True, limit: int | None = None) -> DataFrame:
    """Filings of a country and of years, with a package URL; years compare as numbers."""
    if country:
        filings = filings.where(F.col("country") == country.upper())
    if years:
        filings = filings.where(F.col("fiscal_year").try_cast("int").isin([int(y) for y in years]))
    if need_url:
        filings = filings.where(F.col("package_url").isNotNull())
    return filings if limit is None else filings.orderBy("lei", "period_end", "api_id").limit(limit)


def _newest(id_col: str) -> list[Column]:
    return [F.col("processed").desc_nulls_last(), F.col(id_col).asc_nulls_last()]


def dedup_content(filings: DataFrame, strict: bool = False, id_col: str = "api_id", sha_col: str = "sha256") -> DataFrame:
    """The newest filing of each content hash. Filings without a hash all stay, unless strict: then they are one group."""
    hashed = filings.withColumn(sha_col, expr.hash_of(F.col(sha_col)))
    # hashless filings never meet in one group: each is spread by its own id
    alone = F.when((F.col(sha_col) == "") & F.lit(not strict), F.monotonically_increasing_id())
    w = Window.partitionBy(sha_col, "_alone").orderBy(*_newest(id_col))
    return hashed.withColumn("_alone", alone).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_alone")


def dedup_restatement(filings: DataFrame, id_col: str = "api_id") -> DataFrame:
    """One filing for each (lei, period_end): that with the fewest errors, then the newest; n_versions counts all.

    Filings that lack either key stay, each as the only version of itself. Error counts that aren't numbers come last.
    """
    key = [F.col("lei"), F.col("period_end")]
    known = expr.blank_to_null(F.col("lei")).isNotNull() & expr.blank_to_null(F.col("period_end")).isNotNull()
    errors = F.coalesce(F.col("error_count").try_cast("int"), F.lit(NO_COUNT))
    alone = F.when(~known, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    ranked = filings.withColumn("_alone", alone).withColumn("_errors", errors)
    group = [*key, F.col("_alone")]
    w = Window.partitionBy(*group).orderBy(F.col("_errors").asc(), *_newest(id_col))
    ranked = ranked.withColumn("_rank", F.row_number().over(w)).withColumn("n_versions", F.count(id_col).over(Window.partitionBy(*group)))
    return ranked.where((F.col("_rank") == 1) | (~known)).withColumn("n_versions", F.when(known, F.col("n_versions")).otherwise(1)).drop("_rank", "_alone", "_errors")


def surrogate_ids(filings: DataFrame, to: str = "report_id", tie: str = "api_id") -> DataFrame:
    """R000001 and so on by (lei, period_end), NULLs last.

    A global order is inherent, but only one small row for each entity goes through one task: filings are numbered within their entity, from
    the count of all filings of the entities before it.
    """
    # the same two columns are the window's and the join's key, so that filings are shuffled once; NULL is a key of its own
    keyed = filings.withColumn("_key", F.coalesce("lei", F.lit(""))).withColumn("_null", F.col("lei").isNull())
    counts = keyed.groupBy("_key", "_null").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_null", "_key").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_key", "_null", F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy("_key", "_null").orderBy(*(F.col(c).asc_nulls_last() for c in ("period_end", tie)))
    numbered = keyed.withColumn("_own", F.row_number().over(w)).join(starts, ["_key", "_null"])
    return numbered.select(*filings.columns, F.format_string("R%06d", F.col("_before") + F.col("_own")).alias(to))


def primary_index(filings: DataFrame, strict: bool = False) -> DataFrame:
    """Content dedup, restatement dedup with counts before and after, ids. n_raw is 1 for filings that lack an entity or a period, as each is a group of its own."""
    known = expr.blank_to_null(F.col("lei")).isNotNull() & expr.blank_to_null(F.col("period_end")).isNotNull()
    alone = F.when(~known, F.monotonically_increasing_id())
    counted = filings.withColumn("_alone", alone).withColumn("n_raw", F.count("*").over(Window.partitionBy("lei", "period_end", "_alone"))).drop("_alone")
    return surrogate_ids(dedup_restatement(dedup_content(counted, strict)))


def entities_of(primary: DataFrame) -> DataFrame:
    """One row for each lei with a name; of several names that of the first filing by id."""
    named = primary.where("lei IS NOT NULL AND lei <> '' AND entity_name IS NOT NULL")
    return named.groupBy("lei").agg(F.min_by("entity_name", "report_id").alias("entity_name"), F.min_by("country", "report_id").alias("country"))

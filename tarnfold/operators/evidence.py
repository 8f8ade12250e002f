"""From page text to evidence packets, and checks of what they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

PROMPT_CHARS = 6000
TABLE_MARK = r"\S+ \| \S+ \| \S+"


def page_flags(text: Column, has_table: Column) -> Column:
    """Quality flags of a page."""
    return expr.flags((expr.stripped(F.coalesce(text, F.lit(""))) == "", "native_text_empty"), (F.coalesce(has_table, F.lit(False)), "table_candidate_detected"))


def blocks(pages: DataFrame, text: str = "native_text", keys: tuple[str, ...] = ("report_id", "page_index"), by: str = "\n") -> DataFrame:
    """One row for each block of text that isn't blank: keys, block_index, text."""
    split = pages.select(*keys, F.posexplode(F.split(text, by, -1)).alias("block_index", "text"))
    return split.where(expr.stripped(F.col("text")) != "")


def fragments(blocks_: DataFrame, report: str = "report_id", page: str = "page_index") -> DataFrame:
    """Evidence fragments with ids that are the same on every run."""
    return blocks_.withColumn("id", expr.stable_id("ev", F.col(report), F.col(page), F.col("block_index"))).withColumn("kind", F.lit("text_block"))


def packets(fragments_: DataFrame, report: str = "report_id", page: str = "page_index", order: str = "block_index", task: str = "full_harvest") -> DataFrame:
    """One packet for each page that has fragments, these in their order. A page is a group of its own, so none outgrows a task."""
    item = F.struct(F.col(order).alias("ord"), F.col("id"), F.col(page).alias("page_index"), F.col("kind"), F.col("text"))
    grouped = fragments_.groupBy(report, page).agg(F.array_sort(F.collect_list(item)).alias("primary"))
    return grouped.select(
        expr.stable_id("packet", F.col(report), F.col(page), F.lit(task)).alias("packet_id"), report, page, F.lit(task).alias("task_type"), "primary",
    )


def page_packets(pages: DataFrame, text: str = "native_text", report: str = "report_id", page: str = "page_index", task: str = "full_harvest") -> DataFrame:
    """packets(fragments(blocks(pages))), each built within its page's row, so that no text is shuffled.

    A page that comes in several rows is one packet of all their fragments. That takes the shuffle; only keys are read to see whether there is any.
    """
    most = pages.groupBy(report, page).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > 1:
        return packets(fragments(blocks(pages, text, (report, page)), report, page), report, page, task=task)
    numbered = F.transform(F.split(text, "\n", -1), lambda t, i: F.struct(i.alias("ord"), t.alias("text")))
    filled = F.filter(numbered, lambda x: x["text"].rlike(r"\S"))
    item = lambda x: F.struct(
        x["ord"].alias("ord"), expr.stable_id("ev", F.col(report), F.col(page), x["ord"]).alias("id"), F.col(page).alias("page_index"), F.lit("text_block").alias("kind"), x["text"].alias("text"),
    )
    return pages.where(F.col(text).rlike(r"\S")).select(
        expr.stable_id("packet", F.col(report), F.col(page), F.lit(task)).alias("packet_id"), report, page, F.lit(task).alias("task_type"), F.transform(filled, item).alias("primary"),
    )


def with_context(packets_: DataFrame, pages: int = 1, report: str = "report_id", page: str = "page_index") -> DataFrame:
    """packets with a column context: the fragments of up to `pages` pages before and after, in their order; an empty list where there are none."""
    around = F.explode(F.array(*(F.col(page) + F.lit(i) for i in range(-pages, pages + 1) if i)))
    near = packets_.select(report, around.alias(page), F.col("primary").alias("_items"), F.col(page).alias("_from"))
    held = near.groupBy(report, page).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_items"))), lambda x: x["_items"])).alias("context"))
    return packets_.join(held, [report, page], "left").withColumn("context", F.coalesce("context", F.filter("primary", lambda _: F.lit(False))))


def all_items(primary: Column, context: Column) -> Column:
    """What a request shows and may be cited from: primary evidence, then context."""
    return F.concat(primary, F.coalesce(context, F.filter(primary, lambda _: F.lit(False))))


def cases(fragments_: DataFrame, report: str = "report_id", page: str = "page_index") -> DataFrame:
    """For each report the number of packets, fragments and kinds of fragments that a trial of models has."""
    return fragments_.groupBy(report).agg(F.count_distinct(page).alias("packets"), F.count("*").alias("fragments"), F.count_distinct("kind").alias("kinds"))


def packet_text(primary: Column) -> Column:
    """The fragments' texts, one on a line."""
    return F.array_join(F.transform(primary, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")


def packet_prompt(items: Column, most: int = PROMPT_CHARS) -> Column:
    """What a model is shown: each fragment under its id and page, cut to `most` characters."""
    shown = lambda x: F.concat(F.lit("["), x["id"], F.lit("] page="), (x["page_index"] + 1).cast("string"), F.lit("\n"), F.coalesce(x["text"], F.lit("")))
    return F.substring(F.array_join(F.transform(items, shown), "\n\n"), 1, most)


def packet_refs(items: Column) -> Column:
    return F.transform(items, lambda x: x["id"])


def slice_packets(packets_: DataFrame, start: int = 0, most: int = 10, report: str = "report_id", order: str = "page_index", low: int = 1, high: int = 10) -> DataFrame:
    """Packets start to start + most - 1 of each report, `most` within low and high: cut before anything costly runs."""
    from pyspark.sql import Window

    start, most = max(0, start), max(low, min(most, high))
    w = Window.partitionBy(report).orderBy(order)
    return packets_.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > start) & (F.col("_n") <= start + most)).drop("_n")


def recall(packets_: DataFrame, keywords: list[str], text: Column | None = None) -> DataFrame:
    """Packets whose text holds any of the keywords, without regard to case."""
    keywords = [k for k in keywords if k and k.strip()]
    low = F.lower(packet_text(F.col("primary")) if text is None else text)
    return packets_.where(expr.let(low, lambda t: F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(t, k))) if keywords else F.lit(False))


def recall_by_table(rows: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword") -> DataFrame:
    """The same for keywords in a table, which may be large. Blank keywords recall nothing.

    A keyword is looked up by its longest inner word (one with a sign that isn't a letter or digit on both sides, so that it's a whole word of any text that holds the keyword);
    rows meet only keywords of which they hold that word. Keywords without an inner word are tried on every row, as a table that Spark broadcasts if it is small.
    """
    low = keywords.select(F.lower(keyword).alias("_k")).where(expr.stripped(F.col("_k")) != "").distinct()
    inner = F.regexp_extract_all("_k", F.lit(r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"), 0)
    probed = low.withColumn("_word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    keyed = rows.withColumn("_key", F.xxhash64(text))
    words = keyed.select("_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("_word"))
    maybe = words.join(probed.where("_word IS NOT NULL"), "_word").select("_key", "_k")
    bare = probed.where("_word IS NULL").select("_k")
    maybe = maybe.unionByName(keyed.join(bare, F.contains(F.lower(text), F.col("_k"))).select("_key", "_k")).distinct().withColumnRenamed("_key", "_of")
    return keyed.join(maybe, (F.col("_key") == F.col("_of")) & F.contains(F.lower(text), F.col("_k")), "left_semi").drop("_key")


def supported(evidence_ids: Column, packet_ids: Column) -> Column:
    """Whether there is evidence, and all of it is in the packet."""
    ids = F.coalesce(evidence_ids, F.array().cast("array<string>"))
    return (F.size(ids) > 0) & (F.size(F.array_except(ids, packet_ids)) == 0)


def allowed_only(ids: Column, allowed: Column) -> Column:
    """ids that are allowed, in their order, repeats kept; none for NULL."""
    return F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.array_contains(allowed, x))


def publishable(disclosures: DataFrame, packets_: DataFrame, report: str = "report_id") -> DataFrame:
    """Disclosures whose evidence is non-empty and within their report's packets. Joined by evidence id, so that large reports don't skew."""
    known = packets_.select(F.col(report), F.explode(packet_refs(F.col("primary"))).alias("_ev"), F.lit(1).alias("_known")).distinct()
    cited = disclosures.select("disclosure_id", report, F.explode("evidence_ids").alias("_ev"))
    good = cited.join(known, [report, "_ev"], "left").groupBy("disclosure_id").agg(F.count("*").alias("_n"), F.count("_known").alias("_k")).where("_n = _k")
    return disclosures.join(good.select("disclosure_id"), "disclosure_id", "left_semi")

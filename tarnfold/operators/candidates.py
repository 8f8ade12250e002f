"""Candidate disclosures: the local baseline, and tolerant parsing of model answers with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..schemas import VOCABULARIES

LABEL_CHARS, TEXT_CHARS, CONCEPT_CHARS = 500, 4000, 200
ITEM = (
    "array<struct<raw_label:string,label:string,raw_text:string,evidence_text:string,summary:string,disclosure_type:string,evidence_ids:array<string>,concept_candidates:array<string>>>"
)


def baseline(packets: DataFrame, text: Column, ids: Column, label: Column | None = None) -> DataFrame:
    """Exactly one qualitative candidate for each packet with text: cut to 4000 characters, with all fragment ids."""
    rows = packets.withColumn("_text", text).where(expr.stripped(F.col("_text")) != "")
    return rows.select(
        *packets.columns,
        (label if label is not None else F.lit("packet")).alias("raw_label"),
        F.substring("_text", 1, TEXT_CHARS).alias("raw_text"),
        ids.alias("evidence_ids"),
        F.lit("qualitative").alias("disclosure_type"),
        F.array(F.lit("local_baseline_only"), F.lit("requires_cloud_extraction")).alias("quality_flags"),
    )


def message_content(response: Column) -> Column:
    """The first choice's message: a string, or the texts of its parts on lines; '' if there is none."""
    first_text = F.get_json_object(response, "$.choices[0].message.content[0].text")

    def joined(content: Column) -> Column:
        texts, parts = F.from_json(content, "array<struct<text:string>>"), F.from_json(content, "array<string>")
        return F.array_join(F.zip_with(texts, parts, lambda t, p: F.coalesce(t["text"], p)), "\n")

    content = F.get_json_object(response, "$.choices[0].message.content")
    return F.coalesce(expr.let(content, lambda c: F.when(c.startswith("[") & first_text.isNotNull(), joined(c)).otherwise(c)), F.lit(""))


def json_text(content: Column) -> Column:
    """The JSON in an answer: what is in a fence, else all of it; if that is no JSON, from the first bracket to the last; else NULL."""
    fence = r"(?is)`{3}(?:json\b)?\s*(.*?)`{3}"
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    body = lambda text: F.when(F.contains(text, F.lit("```")) & text.rlike(fence), expr.stripped(F.regexp_extract(text, fence, 1))).otherwise(text)
    whole_or_cut = lambda b: F.coalesce(valid(b), expr.let(expr.part_of(b, r"(?s)([{\[].*[}\]])"), valid))
    return expr.let(expr.stripped(content), lambda text: expr.let(body(text), whole_or_cut))


def items(parsed: Column) -> Column:
    """The disclosures of an object, or a list at the top."""
    inner = F.when(parsed.startswith("["), parsed).otherwise(F.get_json_object(parsed, "$.disclosures"))
    return expr.let(inner, lambda x: F.when(x.startswith("["), F.from_json(x, ITEM)))


def parse(results: DataFrame, response: Column, allowed: Column, keys: list[str]) -> DataFrame:
    """Candidates from model answers: keys, item_index and the columns of a disclosure.

    Aliases fill empty fields in turn, unknown types become qualitative with a flag, ids outside `allowed` go; garbage gives no rows.
    """
    found = expr.let(message_content(response), lambda c: expr.let(json_text(c), items))
    rows = results.select(*keys, F.posexplode(found).alias("item_index", "i"), allowed.alias("_allowed"))
    rows = rows.where("i IS NOT NULL")
    i = F.col("i")
    kind = F.lower(expr.stripped(F.coalesce(expr.blank_to_null(i["disclosure_type"]), F.lit("qualitative"))))
    label = expr.stripped(F.coalesce(expr.first_filled(i["raw_label"], i["label"]), F.concat(F.lit("cloud_disclosure_"), (F.col("item_index") + 1).cast("string"))))
    text = expr.stripped(F.coalesce(expr.first_filled(i["raw_text"], i["evidence_text"], i["summary"]), F.lit("")))
    none = F.array().cast("array<string>")
    ids = F.filter(F.coalesce(i["evidence_ids"], none), lambda x: F.array_contains(F.coalesce(F.col("_allowed"), none), x))
    concepts = F.transform(F.filter(F.coalesce(i["concept_candidates"], none), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.substring(x, 1, CONCEPT_CHARS))
    rows = rows.select(*keys, "item_index", kind.alias("_kind"), label.alias("_label"), text.alias("_text"), ids.alias("evidence_ids"), concepts.alias("concept_candidates"))
    known = F.col("_kind").isin(sorted(VOCABULARIES["disclosure_type"]))
    marks = expr.flags(
        (F.lit(True), "cloud_candidate"),
        (F.size("evidence_ids") == 0, "missing_valid_evidence_id"),
        (~known, F.concat(F.lit("normalized_disclosure_type:"), F.col("_kind"))),
        (F.col("_text") == "", "missing_raw_text"),
    )
    return rows.select(
        *keys,
        "item_index",
        F.when(known, F.col("_kind")).otherwise("qualitative").alias("disclosure_type"),
        F.substring("_label", 1, LABEL_CHARS).alias("raw_label"),
        F.substring(F.when(F.col("_text") == "", F.col("_label")).otherwise(F.col("_text")), 1, TEXT_CHARS).alias("raw_text"),
        "evidence_ids",
        "concept_candidates",
        marks.alias("quality_flags"),
    )


def fusion_flags(conflicts: Column, result_id: Column, parsed: Column, has_coordinates: Column) -> Column:
    """Conflicts so far, with flags for an answer that wasn't parsed or has no coordinates."""
    so_far = F.coalesce(conflicts, F.array().cast("array<string>"))
    return F.concat(
        so_far,
        expr.flags(
            (parsed.isNull(), F.concat(F.lit("cloud_result_unparsed:"), result_id)),
            (~F.coalesce(has_coordinates, F.lit(False)), F.concat(F.lit("cloud_coordinates_missing:"), result_id)),
        ),
    )


def observations(disclosures: DataFrame) -> DataFrame:
    """Quantitative candidates: the first number of each quantitative disclosure's text, and the unit after it."""
    number = r"(-?\d[\d,]*(?:\.\d+)?)\s*([A-Za-z%][A-Za-z0-9%/]*)?"
    text = F.col("raw_text")
    value = expr.part_of(text, number, 1)
    rows = disclosures.where("disclosure_type = 'quantitative'")
    return rows.select(
        expr.stable_id("obs", F.col("disclosure_id")).alias("id"), "disclosure_id", F.coalesce(value, F.lit("")).alias("value_text"),
        F.replace(value, F.lit(","), F.lit("")).try_cast("double").alias("value"), expr.part_of(text, number, 2).alias("unit"), "evidence_ids",
    )

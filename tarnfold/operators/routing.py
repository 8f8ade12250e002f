"""Models by capability: inference from names, selection, and a router with pins and preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

DEFAULT_CONTEXT, LONG_CONTEXT, LONGEST_CONTEXT = 32_768, 262_144, 1_000_000
VISION_MARKS = ("multimodal", "visual", "vision", "vl")
REASONING_MARKS = ("r1", "reason", "thinking", "m2.7", "glm-5", "deepseek-v4-pro")
LONGEST_MARKS = ("kimi-k2.6", "longcat", "minimax-m3", "glm-5", "deepseek-v4")
LONG_MARKS = ("qwen-max", "minimax", "doubao-seed", "kimi", "qwen3")

#: task -> (image, schema, reasoning, least context, reason)
NEEDS = {
    "vision_ocr": (True, False, False, 32_000, "requires_image"),
    "table_vision_extract": (True, False, False, 32_000, "requires_image"),
    "visual_verification": (True, False, False, 32_000, "requires_image"),
    "structured_extract": (False, True, False, 64_000, "requires_schema"),
    "verification": (False, True, False, 64_000, "requires_schema"),
    "qualitative_summarization": (False, False, False, 128_000, "requires_long_context_or_reasoning"),
    "long_context_understanding": (False, False, False, 128_000, "requires_long_context_or_reasoning"),
    "mapping_review": (False, False, True, 128_000, "requires_long_context_or_reasoning"),
    "page_classification": (False, False, False, 32_000, "default_low_requirement"),
}
#: task -> settings that may pin a model, the first that is set
PINS = {t: ("text",) for t in NEEDS} | {t: ("vision",) for t, n in NEEDS.items() if n[0]} | {"mapping_review": ("reasoning", "text"), "page_classification": ("fast", "text")}
#: model -> the tasks it is preferred for, each with its place in that task's order
PREFERENCES = {
    "qwen-turbo": {"page_classification": 2, "structured_extract": 5},
    "qwen3-max": {"mapping_review": 4},
    "qwen3-next-80b-a3b-thinking": {"verification": 4},
    "qwen3-next-80b-a3b-instruct": {"page_classification": 3, "structured_extract": 3, "qualitative_summarization": 3},
    "qwen2.5-vl-72b-instruct": {"vision_ocr": 3, "table_vision_extract": 3},
    "qwen-vl-max-2025-01-25": {"vision_ocr": 2, "table_vision_extract": 2, "visual_verification": 3},
    "qwen/qwen3.5-plus": {"vision_ocr": 1, "table_vision_extract": 1, "visual_verification": 2, "structured_extract": 4},
    "moonshotai/kimi-k2.5": {"vision_ocr": 4, "table_vision_extract": 4, "visual_verification": 1},
    "minimax/minimax-m2.7": {"mapping_review": 3, "verification": 3},
    "z-ai/glm-5": {"mapping_review": 2, "verification": 1},
    "z-ai/glm-5.2": {"long_context_understanding": 3},
    "doubao-seed-1.6-flash": {"qualitative_summarization": 2},
    "doubao-seed-2.0-lite": {"structured_extract": 1},
    "deepseek/deepseek-v4-pro": {"long_context_understanding": 2, "mapping_review": 1, "verification": 2},
    "deepseek/deepseek-v4-flash": {"page_classification": 1, "structured_extract": 2, "qualitative_summarization": 1, "long_context_understanding": 1},
}


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def inferred(text: Column) -> dict[str, Column]:
    """Capabilities that a model's id, name and features suggest."""
    low = F.lower(text)
    context = F.when(_any(low, LONGEST_MARKS), LONGEST_CONTEXT).when(_any(low, LONG_MARKS), LONG_CONTEXT).otherwise(DEFAULT_CONTEXT).cast("bigint")
    return {
        "input_modalities": F.when(_any(low, VISION_MARKS), F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text"))),
        "context_length": context,
        "supports_reasoning": _any(low, REASONING_MARKS),
        "supports_schema": F.lit(True),
    }


def capabilities(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Models from JSON records: the architecture's word first, then the record's own, then what the name suggests; flags if any says so.

    The record within "raw" counts for the architecture if it has the same id.
    """
    get = lambda path: F.get_json_object(json_col, path)
    raw = lambda path: F.when(F.col("_inner"), get(f"$.raw.{path}")).otherwise(get(f"$.{path}"))
    # nullif has its first argument twice, and each would parse the record
    nullif = lambda c, none: expr.let(c, lambda x: F.nullif(x, none))
    strings = lambda c: nullif(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    true = lambda c: F.coalesce(c.try_cast("boolean"), F.lit(False))
    number = lambda c: nullif(c.try_cast("bigint"), F.lit(0))
    filled = lambda c: nullif(c, F.lit(""))
    features = strings(get("$.features"))
    # what is asked for again and again is a column of a step before, so that the record isn't parsed for each mark of a name
    marked = records.select(json_col, (get("$.raw.id") == get("$.id")).alias("_inner"))
    marked = marked.select("*", F.concat_ws(" ", get("$.id"), raw("name"), F.array_join(F.coalesce(strings(raw("features")), F.array().cast("array<string>")), " ")).alias("_about"))
    guess = inferred(F.col("_about"))
    text = F.array(F.lit("text"))
    return marked.select(
        get("$.id").alias("id"),
        get("$.name").alias("name"),
        F.coalesce(strings(raw("architecture.input_modalities")), strings(get("$.input_modalities")), guess["input_modalities"]).alias("input_modalities"),
        F.coalesce(strings(raw("architecture.output_modalities")), strings(get("$.output_modalities")), text).alias("output_modalities"),
        F.coalesce(features, F.array(F.lit("inferred_capabilities_from_model_id"))).alias("features"),
        F.coalesce(number(raw("model_constraints.context_length")), number(get("$.context_length")), guess["context_length"]).alias("context_length"),
        F.coalesce(number(raw("model_constraints.max_tokens")), number(get("$.max_tokens"))).alias("max_tokens"),
        F.lit(True).alias("supports_schema"),
        (true(raw("architecture.function_calling.supported")) | true(get("$.supports_function_calling"))).alias("supports_functions"),
        (true(raw("architecture.reasoning.supported")) | true(get("$.supports_reasoning")) | guess["supports_reasoning"]).alias("supports_reasoning"),
        F.coalesce(strings(raw("support_api_protocols")), strings(get("$.support_api_protocols")), F.array().cast("array<string>")).alias("protocols"),
        F.coalesce(filled(raw("retirement_at")), filled(get("$.retirement_at"))).alias("retirement_at"),
        F.coalesce(filled(raw("suggested_model")), filled(get("$.suggested_model"))).alias("suggested_model"),
    ).where("id IS NOT NULL")


def meets(image: bool = False, schema: bool = False, reasoning: bool = False, context: int = 0) -> Column:
    ok = F.nullif(F.col("retirement_at"), F.lit("")).isNull() & (F.coalesce("context_length", F.lit(0)) >= context)
    ok = ok & F.array_contains("input_modalities", "image") if image else ok
    ok = ok & F.col("supports_schema") if schema else ok
    return ok & F.col("supports_reasoning") if reasoning else ok


def best(models: DataFrame, by: list[str] | None = None, order: str = "ordinal") -> DataFrame:
    """Of the models (in each group), the id of that with the longest context; of equals, one that calls functions, then the first by order."""
    rank = F.struct(F.coalesce("context_length", F.lit(0)).alias("c"), F.coalesce("supports_functions", F.lit(False)).alias("f"), (-F.col(order)).alias("o"))
    return models.groupBy(*(by or [])).agg(F.max_by("id", rank).alias("model_id"))


def select(models: DataFrame, **needs) -> DataFrame:
    """One row: the best model that meets the needs, NULL if none does."""
    return best(models.where(meets(**needs)))


def decision_table(spark: SparkSession, pins: dict[str, str] | None = None) -> DataFrame:
    """(task, image, schema, reasoning, context, reason, pin): what each task asks of a model."""
    pins = pins or {}
    rows = [(t, *n, next((pins[k] for k in PINS[t] if pins.get(k)), None)) for t, n in NEEDS.items()]
    return spark.createDataFrame(rows, "task string, image boolean, schema boolean, reasoning boolean, context bigint, reason string, pin string")


def preference_table(spark: SparkSession, preferences: dict[str, dict[str, int]] = PREFERENCES) -> DataFrame:
    return spark.createDataFrame([(t, m, r) for m, x in preferences.items() for t, r in x.items()], "task string, id string, place int")


def route(models: DataFrame, tasks: DataFrame, preferences: DataFrame) -> DataFrame:
    """(task, model_id, in_registry, reason): a pin; else the preferred model that is there; else the best that meets the task's needs.

    A pin that the registry doesn't know is kept, and the reason says so.
    """
    t = tasks.alias("t")
    ok = (
        F.nullif("retirement_at", F.lit("")).isNull()
        & (F.coalesce("context_length", F.lit(0)) >= F.col("context"))
        & (~F.col("image") | F.array_contains("input_modalities", "image"))
        & (~F.col("schema") | F.col("supports_schema"))
        & (~F.col("reasoning") | F.col("supports_reasoning"))
    )
    able = best(t.crossJoin(models).where(ok), ["task"]).withColumnRenamed("model_id", "able")
    ids = models.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    preferred = preferences.join(ids, "id").groupBy("task").agg(F.min_by("id", "place").alias("preferred"))
    pinned = ids.select(F.col("id").alias("pin"), F.lit(True).alias("_known"))
    all_ = tasks.join(pinned, "pin", "left").join(preferred, "task", "left").join(able, "task", "left")
    reason = (
        F.when(F.col("pin").isNotNull() & F.col("_known"), "explicit_env_model")
        .when(F.col("pin").isNotNull(), "explicit_env_model_not_in_registry")
        .when(F.col("preferred").isNotNull(), "preferred_available_model")
        .otherwise(F.col("reason"))
    )
    model = F.coalesce("pin", "preferred", "able")
    there = F.when(F.col("pin").isNotNull(), F.coalesce("_known", F.lit(False))).otherwise(model.isNotNull())
    return all_.select("task", model.alias("model_id"), there.alias("in_registry"), reason.alias("reason"))


def assessment(spark: SparkSession, preferences: dict[str, dict[str, int]] = PREFERENCES) -> DataFrame:
    """What each task asks for, its default model and alternatives, and how it is called and reviewed."""
    calls = {True: "one page image a call, only where the local text is missing or doubtful", False: "packets in batches, low temperature, ids of the evidence in every answer"}
    review = {"mapping_review": "every mapping waits for a person", "verification": "disagreements wait for a person", "visual_verification": "disagreements wait for a person"}
    rows = []
    for task, (image, schema, reasoning, context, _) in NEEDS.items():
        order = [m for _, m in sorted((x[task], m) for m, x in preferences.items() if task in x)]
        needs = [n for n, on in (("image input", image), ("schema output", schema), ("reasoning", reasoning)) if on] + [f"context of {context} or more"]
        rows.append((task, needs, order[0] if order else None, order[1:], calls[image], review.get(task, "spot checks")))
    return spark.createDataFrame(rows, "task string, needs array<string>, default_model string, alternatives array<string>, call_policy string, review_policy string")

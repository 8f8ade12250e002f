"""The report workflow end to end, on tables: pages to packets to candidates, local or with a completer that is handed in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import expr
from .operators import candidates, evidence
from .sources.api import complete_tasks

STEPS = (
    ("pages", "local"), ("packets", "local"), ("classification", "api"), ("visual reading", "api"), ("structured extraction", "api"),
    ("summaries", "api"), ("mapping review", "api"), ("verification", "api"), ("evidence check", "local"), ("storage", "local"),
)
INSTRUCTION = (
    'Name the sustainability disclosures in the evidence below, and nothing that it does not say. Answer in JSON: {"disclosures": [{"raw_label", "raw_text", '
    '"disclosure_type", "evidence_ids", "concept_candidates"}]}; evidence_ids are the bracketed ids.\n\n'
)


@dataclass(frozen=True)
class State:
    """What a run has made, and how far it got: created, local_evidence_prepared, local_pipeline_completed or cloud_pipeline_completed."""

    status: str = "created"
    pages: DataFrame | None = None
    packets: DataFrame | None = None
    results: DataFrame | None = None
    disclosures: DataFrame | None = None


def steps(completed: bool = False, api_completed: bool = False) -> list[dict[str, str]]:
    """The workflow's steps with their mode and status."""
    local = ("pending", "completed")[completed]
    paid = "completed" if api_completed else ("planned", "planned_not_run")[completed]
    return [{"step": s, "mode": m, "status": {"api": paid, "local": local}[m]} for s, m in STEPS]


def prepare(pages: DataFrame, context_pages: int = 0) -> State:
    """pages: report_id, page_index, native_text. Pages without text give no packet; context_pages on either side are shown with a packet."""
    packets = evidence.page_packets(pages)
    return State("local_evidence_prepared", pages, evidence.with_context(packets, context_pages) if context_pages else packets)


def run_local(pages: DataFrame) -> State:
    """The baseline: one qualitative candidate a packet."""
    s = prepare(pages)
    rows = candidates.baseline(s.packets, evidence.packet_text(F.col("primary")), evidence.packet_refs(F.col("primary")), F.concat(F.lit("page "), (F.col("page_index") + 1).cast("string")))
    rows = rows.withColumn("disclosure_id", expr.stable_id("disc", F.col("packet_id"), F.lit("local"))).withColumn("concept_candidates", F.array().cast("array<string>"))
    return State("local_pipeline_completed", s.pages, s.packets, None, rows.select("disclosure_id", "report_id", "disclosure_type", "raw_label", "raw_text", "evidence_ids", "concept_candidates", "quality_flags"))


def tasks(packets: DataFrame, model_id: str, start: int = 0, most: int = 10) -> DataFrame:
    """Requests for the packets from start on, at most `most` of each report: cut before anything costly."""
    cut = evidence.slice_packets(packets, start, most)
    items = evidence.all_items(F.col("primary"), F.col("context")) if "context" in packets.columns else F.col("primary")
    return cut.select(
        expr.stable_id("task", F.col("packet_id"), F.lit(model_id)).alias("request_id"), "report_id", F.lit(model_id).alias("model_id"), F.lit("structured_extract").alias("task_type"),
        F.concat(F.lit(INSTRUCTION), evidence.packet_prompt(items)).alias("prompt"), evidence.packet_refs(items).alias("input_refs"),
    )


def run_cloud(pages: DataFrame, completer: Callable[[str, str], str], model_id: str, results_path: str, start: int = 0, most: int = 10) -> State:
    """Answers are written to results_path before they are parsed, so that none is paid for twice; disclosures come from what was written."""
    s = prepare(pages)
    asked = tasks(s.packets, model_id, start, most)
    complete_tasks(asked, completer).write.mode("overwrite").parquet(results_path)
    results = pages.sparkSession.read.parquet(results_path)
    rows = candidates.parse(results.join(asked.select("request_id", "input_refs"), "request_id"), F.col("response"), F.col("input_refs"), ["request_id", "report_id"])
    rows = rows.withColumn("disclosure_id", expr.stable_id("disc", F.col("request_id"), F.col("item_index")))
    return State("cloud_pipeline_completed", s.pages, s.packets, results, rows)

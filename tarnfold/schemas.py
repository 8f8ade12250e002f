"""Table schemas, closed vocabularies, and the constraints that audits check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_FILING = (
    "api_id string, fxo_id string, lei string, entity_name string, country string, report_type string, seq int, period_end string, fiscal_year string, sha256 string, "
    "error_count string, warning_count string, inconsistency_count string, processed string, date_added string, package_url string, json_url string, viewer_url string"
)
PRIMARY_FILING = RAW_FILING + ", n_versions bigint, n_raw bigint, report_id string"
ENTITY = "lei string, entity_name string, company_alias string, country string, industry_code string, industry_name string"
EXCHANGE = "exchange_id string, exchange_name string, country string"
DATAPOINT = "code string, topic string, topic_name string, name string, local_name string, unit string"
INDICATOR = "id bigint, report_id string, code string, raw_label string, value_num double, unit string, scope string, fiscal_year int, source string, confidence string, page_or_anchor string"
LEDGER = "seq bigint, report_id string, lei string, entity_name string, period_end string, fiscal_year int, file string, size_mb double, status string, esg_flag int, msg string"
COVERAGE = "country string, report_year int, collected bigint"
MODEL = (
    "id string, name string, input_modalities array<string>, output_modalities array<string>, features array<string>, context_length bigint, max_tokens bigint, "
    "supports_schema boolean, supports_functions boolean, supports_reasoning boolean, protocols array<string>, retirement_at string, suggested_model string"
)

REPORTS = "report_id string, artifact_path string, sha256 string, page_count int, created_at timestamp, document_json string"
PAGES = "report_id string, page_index int, native_text string, width double, height double, quality_flags array<string>"
FRAGMENT = "id string, page_index int, kind string, text string"
PACKETS = f"packet_id string, report_id string, task_type string, page_index int, primary array<struct<{FRAGMENT.replace(' string', ':string').replace(' int', ':int')}>>, context array<struct<{FRAGMENT.replace(' string', ':string').replace(' int', ':int')}>>"
DISCLOSURES = "disclosure_id string, report_id string, disclosure_type string, raw_label string, raw_text string, evidence_ids array<string>, concept_candidates array<string>, quality_flags array<string>"
RESULTS = "request_id string, report_id string, model_id string, task_type string, response string"
OBSERVATIONS = "id string, disclosure_id string, value_text string, value double, unit string, period_text string, dimensions map<string,string>, evidence_ids array<string>, quality_flags array<string>"
CLAIMS = "id string, disclosure_id string, subject string, predicate string, object string, status string, qualifiers map<string,string>, evidence_ids array<string>, quality_flags array<string>"
MAPPINGS = "id string, source_id string, target_id string, target_type string, relation string, rationale string, evidence_ids array<string>, review_state string"

VOCABULARIES = {
    "ledger_status": {"ok", "skip", "fail"},
    "indicator_source": {"xbrl-json", "text-anchor"},
    "confidence": {"high", "medium"},
    "disclosure_type": {"governance", "methodology", "policy", "qualitative", "quantitative", "risk", "target"},
    "evidence_kind": {"cloud_ocr", "figure", "note", "page_crop", "table_candidate", "table_region", "text_block"},
    "packet_task": {"full_harvest", "mapping_review", "page_classification", "qualitative_claim_mining", "quant_table_mining", "targeted_recall", "verification", "vision_ocr"},
    "router_task": {
        "long_context_understanding", "mapping_review", "page_classification", "qualitative_summarization", "structured_extract", "table_vision_extract", "verification", "vision_ocr", "visual_verification",
    },
    "block_role": {"footer", "footnote", "header", "paragraph", "table_text", "title", "unknown"},
    "mapping_relation": {"alternative_measure", "broader", "conditional", "exact", "narrower", "not_equivalent", "partial"},
    "mapping_target": {"canonical_concept", "framework_requirement"},
    "review_state": {"approved", "candidate", "rejected", "review_required"},
}
VOCABULARIES["cloud_task"] = VOCABULARIES["router_task"] | {"file_recognition"}

#: table -> (primary key, further unique keys, columns that must not be null)
CONSTRAINTS = {
    "entity": (("lei",), (), ("entity_name",)),
    "exchange": (("exchange_id",), (), ()),
    "datapoint": (("code",), (), ("topic",)),
    "report_raw": (("fxo_id",), (), ("lei", "period_end", "report_type")),
    "report": (("report_id",), (("fxo_id",), ("sha256",), ("lei", "period_end")), ("lei", "period_end")),
    "indicator": (("id",), (("report_id", "code", "scope", "unit"),), ("report_id", "code")),
}

#: What partitioning and bucketing the large tables should be written with.
LAYOUT = {"report_raw": {"bucket": "lei"}, "report": {"partition": ("country", "report_year"), "bucket": "lei"}, "ledger": {"bucket": "report_id"}}

_DATAPOINTS = """
G1|Business conduct|Confirmed incidents of corruption|腐败事件|
S1|Own workforce|Total number of employees|劳动力总数|
E3-4|Water|Water consumption|水资源消耗|m3
E1-8|Climate change|Internal carbon pricing|内部碳价|
E1-7|Climate change|GHG removals|GHG移除|
E1-6|Climate change|Gross Scope 1/2/3 GHG emissions|GHG排放(Scope1/2/3)|tCO2e
E1-5|Climate change|Energy consumption and mix|能源消耗与结构|MWh
"""


def datapoints(spark: SparkSession) -> DataFrame:
    """The seeded data points; the topic is derived from the code."""
    rows = [tuple(x or None for x in line.split("|")) for line in _DATAPOINTS.strip().splitlines()]
    from .functions.expr import topic_of

    df = spark.createDataFrame(rows, "code string, topic_name string, name string, local_name string, unit string")
    return df.withColumn("topic", topic_of(df["code"])).select("code", "topic", "topic_name", "name", "local_name", "unit")

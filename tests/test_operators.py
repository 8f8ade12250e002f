"""Edge rows that the driver's tables lack, each against a plain-Python form of what the operator means."""

import json

import pytest
from pyspark.sql import functions as F

from tarnfold import schemas
from tarnfold.functions import expr
from tarnfold.operators import candidates, coverage, evidence, index, ledger, quality, routing, store

FILING = "api_id string, lei string, period_end string, sha256 string, processed string, error_count string, entity_name string, country string"


def filings(spark, rows):
    return spark.createDataFrame(rows, FILING)


EDGE = [
    ("1", "L1", "2022-12-31", "aa", "2023-01-01", "3", "One", "GB"),
    ("2", "L1", "2022-12-31", "AA", "2023-02-01", "9", "One", "GB"),  # the same content, newer
    ("3", "L1", "2022-12-31", "bb", "2023-03-01", "0", "One", "GB"),
    ("4", "L1", "2022-12-31", "cc", "2023-03-01", "0", "One", "GB"),  # as good as the one before
    ("5", "L2", "2022-12-31", None, "2023-01-01", "x", "Two", "FR"),
    ("6", "L2", "2021-12-31", "", None, None, "Two", "FR"),
    ("7", None, "2021-12-31", "dd", "2023-01-01", "1", None, None),
    ("8", None, "2021-12-31", "ee", "2023-01-01", "0", None, None),
    ("9", "L3", None, "ff", "2023-01-01", "0", "Three", "DE"),
    ("10", "L3", None, "gg", "2023-01-01", "0", "Three", "DE"),
    ("11", "L-4-a", "2020-06-30", "hh", "2023-01-01", "12", "Four", "DE"),
]


def test_two_stage_dedup(spark):
    raw = filings(spark, EDGE)
    content = {r.api_id for r in index.dedup_content(raw).collect()}
    assert content == {"2", "3", "4", "5", "6", "7", "8", "9", "10", "11"}
    assert {r.api_id for r in index.dedup_content(raw, strict=True).collect()} == content - {"6"}
    kept = {r.api_id: r.n_versions for r in index.dedup_restatement(index.dedup_content(raw)).collect()}
    assert kept == {"3": 3, "5": 1, "6": 1, "7": 1, "8": 1, "9": 1, "10": 1, "11": 1}
    assert index.primary_index(filings(spark, [])).count() == 0


def test_surrogate_ids_have_no_holes(spark):
    rows = [(str(i), f"L{i % 50:03d}", f"20{i % 25:02d}-12-31", "", None, None, None, None) for i in range(3000)] + [("x", None, None, None, None, None, None, None)]
    out = index.surrogate_ids(filings(spark, rows).repartition(5)).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, r[2] or "", r[0]))
    assert {r.api_id: r.report_id for r in out} == {r[0]: f"R{k + 1:06d}" for k, r in enumerate(want)}


def test_audit_and_entities(spark):
    raw = filings(spark, EDGE)
    primary = index.primary_index(raw)
    entities = index.entities_of(primary)
    assert {(r.lei, r.entity_name) for r in entities.collect()} == {("L1", "One"), ("L2", "Two"), ("L3", "Three"), ("L-4-a", "Four")}
    got = {r.check_name: r.violations for r in quality.index_audit(raw, index.dedup_content(raw), primary, entities).collect()}
    assert got["content hash is unique"] == got["versions add up to filings after content dedup"] == 0
    assert got["every filing has an entity"] == 2


def test_quarantine(spark):
    good, bad = quality.quarantine(spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (None, "b")], "k int, v string"), ["v"], "k", [F.col("v")])
    assert [r.k for r in good.collect()] == [1, 2] and sorted(r.reason for r in bad.collect()) == ["null k", "null v"]


def test_expressions(spark):
    row = spark.createDataFrame([("529900ABC-X1-2022-12-31-ESEF-GB-0", "junk", "/a", "https://x/a", "2023", None, "")], "fxo string, bad string, p string, u string, y string, n string, e string").select(
        expr.filing_id_parts(F.col("fxo")).alias("a"), expr.filing_id_parts(F.col("bad")).alias("b"), expr.absolute_url(F.col("p"), "https://h").alias("c"), expr.absolute_url(F.col("u"), "https://h").alias("d"),
        expr.fiscal_year(F.lit("20x2-01-01")).alias("f"), expr.fiscal_year_anywhere(F.col("n"), F.col("e"), F.lit("http://h/2021/x")).alias("g"), expr.report_year(F.lit("junk")).alias("h"),
        expr.safe_name(F.lit("a b/ü.zip")).alias("i"), expr.safe_upload_name(F.lit("/x/..a  b__.pdf_")).alias("j"), expr.package_name(F.lit("L 1"), F.lit("2022-12-31"), F.col("n")).alias("k"),
        expr.lei_by_prefix(F.lit("-x"), F.lit("E")).alias("l"), expr.lei_of(F.col("e"), F.col("fxo")).alias("m"), expr.has_anchor(F.col("n")).alias("o"), expr.has_anchor(F.lit("Scope 1 and 3")).alias("q"),
        expr.topic_of(F.lit("E1-6")).alias("t"), expr.stable_id("x", F.lit("a"), F.col("n")).alias("v"), expr.stable_id("x", F.lit("a"), F.col("e")).alias("w"), expr.stripped(F.lit("\t a \n")).alias("z"),
    ).first()
    assert tuple(row.a) == ("529900ABC-X1", "2022-12-31", "ESEF", "GB", 0) and tuple(row.b) == (None,) * 5
    assert (row.c, row.d, row.f, row.g, row.h) == ("https://h/a", "https://x/a", None, "2021", None)
    assert (row.i, row.j, row.k) == ("a_b__.zip", "a_b__.pdf", "L_1_2022-12-31_nohash.zip")
    assert (row.l, row.m, row.o, row.q, row.t, row.z) == ("E", "529900ABC-X1", 0, 1, "E1", "a") and row.v != row.w


def test_boxes_kinds_and_tables(spark):
    from tarnfold.sources.archives import table_shape

    df = spark.createDataFrame([(1.0, 2.0, 4.0, 8.0, "figure", [["a"], ["b", "c"]]), (0.0, 0.0, 0.0, 0.0, None, [])], "a double, b double, c double, d double, k string, t array<array<string>>")
    row = df.select(expr.box_size(*(F.col(c) for c in "abcd")).alias("box"), expr.fragment_kind_ok(F.col("k")).alias("ok"), table_shape(F.col("t")).alias("shape")).collect()
    assert tuple(row[0].box) == (3.0, 6.0) and [r.ok for r in row] == [True, False] and [tuple(r["shape"]) for r in row] == [(2, 2), (0, 0)]


def test_coverage(spark):
    rows = [("2020", "A", "X"), ("2020", "B", "X"), (None, "A", "X"), ("2021", None, None)]
    df = spark.createDataFrame(rows, "fiscal_year string, report_type string, country string")
    assert [tuple(r) for r in coverage.by_year_and_type(df, ["A", "B"]).collect()] == [("2020", 1, 1, 2)]
    assert [tuple(r) for r in coverage.by_country_and_year(df, ["2020"]).collect()] == [("X", 2, 1, 3)]
    years = spark.createDataFrame([("a", 2000), ("a", 2003), ("b", 2001)], "lei string, fiscal_year int")
    got = {(r.lei, r.missing_year, r.kind) for r in coverage.gaps(years, cutoff=2002).collect()}
    assert got == {("a", 2001, "interrupted"), ("a", 2002, "interrupted"), ("b", 2002, "until_cutoff")}
    assert {(r.lei, r.missing_year) for r in coverage.gaps(years).collect()} == {("a", 2001), ("a", 2002)}


def test_ledger(spark):
    rows = [(1, "r1", "fail", 1e6, 0), (2, "r1", "ok", 2e6, 1), (3, "r2", "ok", 1e6, None), (4, "r1", "skip", None, 1), (5, "r3", "fail", 0.0, 1)]
    df = spark.createDataFrame(rows, "seq long, report_id string, status string, n_bytes double, esg_flag int").withColumn("file", F.lit("f"))
    assert tuple(ledger.anchor_hits(df).first()) == (2, 1)
    assert {r.report_id for r in ledger.failures(df).collect()} == {"r3"}
    reports = spark.createDataFrame([("r1", 0), ("r9", 0)], "report_id string, esg_flag int")
    assert {(r.report_id, r.esg_flag) for r in ledger.enrich(reports, df).collect()} == {("r1", 1), ("r9", 0)}
    have = spark.createDataFrame([("r1", 5), ("r2", 0)], "report_id string, size long")
    assert [r.report_id for r in ledger.pending(reports, have, "report_id").collect()] == ["r9"]
    plan = ledger.plan(reports, have, "report_id").first()
    assert (plan.matched, plan.have, plan.todo) == (2, 1, 1) and plan.todo_gb == 15 / 1024


def response(content):
    return json.dumps(dict(choices=[dict(message=dict(content=content))]))


ANSWERS = [
    ("plain", response('{"disclosures": [{"raw_label": "a", "raw_text": "t", "disclosure_type": "target", "evidence_ids": ["e1", "e1", "no"]}]}'), [("target", "a", "t", ["e1", "e1"], ["cloud_candidate"])]),
    ("fenced", response('Sure.\n```JSON\n{"disclosures": [{"label": "b", "summary": "s"}]}\n```'), [("qualitative", "b", "s", [], ["cloud_candidate", "missing_valid_evidence_id"])]),
    ("list", response('[{"raw_label": "", "evidence_text": "x", "evidence_ids": null, "concept_candidates": null, "disclosure_type": " Magic "}]'), [("qualitative", "cloud_disclosure_1", "x", [], ["cloud_candidate", "missing_valid_evidence_id", "normalized_disclosure_type:magic"])]),
    ("cut", response('see {"disclosures": [{"raw_label": "c", "evidence_ids": ["e1"]}]} done'), [("qualitative", "c", "c", ["e1"], ["cloud_candidate", "missing_raw_text"])]),
    ("parts", response([{"type": "text", "text": '{"disclosures": ['}, {"type": "text", "text": '{"raw_label": "p", "raw_text": "q", "evidence_ids": ["e1"]}]}'}]), [("qualitative", "p", "q", ["e1"], ["cloud_candidate"])]),
    ("garbage", response("no json {"), []),
    ("no list", response('{"disclosures": {"a": 1}}'), []),
    ("empty", response(""), []),
    ("none", "{}", []),
    ("null", None, []),
    ("long", response(json.dumps({"disclosures": [{"raw_label": "l" * 600, "raw_text": "😀" * 5000, "evidence_ids": ["e1"], "concept_candidates": ["c" * 300, "", None]}]})), [("qualitative", "l" * 500, "😀" * 4000, ["e1"], ["cloud_candidate"])]),
]


def test_answers(spark):
    df = spark.createDataFrame([(n, r) for n, r, _ in ANSWERS], "name string, response string")
    out = candidates.parse(df, F.col("response"), F.array(F.lit("e1")), ["name"]).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.name, r.item_index)):
        got.setdefault(r.name, []).append((r.disclosure_type, r.raw_label, r.raw_text, r.evidence_ids, r.quality_flags))
    assert got == {n: w for n, _, w in ANSWERS if w}
    assert next(r.concept_candidates for r in out if r.name == "long") == ["c" * 200]


def test_packets_and_support(spark):
    pages = spark.createDataFrame([("r", 0, "one\n\n two \n"), ("r", 1, " \n\t"), ("r", 2, None)], "report_id string, page_index int, native_text string")
    packets = evidence.packets(evidence.fragments(evidence.blocks(pages)))
    row = packets.select("packet_id", evidence.packet_text(F.col("primary")).alias("t"), evidence.packet_refs(F.col("primary")).alias("ids"), evidence.packet_prompt(F.col("primary"), 30).alias("p")).collect()
    assert len(row) == 1 and row[0].t == "one\n two " and len(set(row[0].ids)) == 2 and len(row[0].p) == 30
    again = evidence.packets(evidence.fragments(evidence.blocks(pages))).first()
    assert again.packet_id == row[0].packet_id
    sets = spark.createDataFrame([(["a"], ["a", "b"]), ([], ["a"]), (None, ["a"]), (["a", "x"], ["a"])], "e array<string>, p array<string>")
    assert [r[0] for r in sets.select(evidence.supported(F.col("e"), F.col("p"))).collect()] == [True, False, False, False]
    assert evidence.recall(packets, ["TWO"]).count() == 1 and evidence.recall(packets, ["three"]).count() == evidence.recall(packets, []).count() == 0


def test_models(spark):
    records = [
        {"id": "plain", "object": "model"}, {"id": "big-vl-2", "object": "model"}, {"id": "z", "raw": {"id": "z", "model_constraints": {"context_length": 5000}, "architecture": {"input_modalities": ["text", "image"]}}},
        {"id": "old", "context_length": 9_000_000, "retirement_at": "2024"}, {"id": "f", "features": ["thinking"], "supports_function_calling": True, "context_length": 32768},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "ordinal int, record string")
    caps = routing.capabilities(df).join(df.select(F.get_json_object("record", "$.id").alias("id"), "ordinal"), "id")
    got = {r.id: r for r in caps.collect()}
    assert got["big-vl-2"].input_modalities == ["text", "image"] and got["big-vl-2"].context_length == 32_768 and got["z"].context_length == 5000
    assert got["f"].supports_reasoning and got["f"].supports_functions and not got["plain"].supports_reasoning
    assert routing.select(caps, image=True, context=32_000).first().model_id == "big-vl-2"
    assert routing.select(caps).first().model_id == "f" and routing.select(caps, context=1 << 40).first().model_id is None
    routed = {r.task: r for r in routing.route(caps, routing.decision_table(spark, {"vision": "z"}), routing.preference_table(spark)).collect()}
    assert routed["vision_ocr"].model_id == "z" and routed["vision_ocr"].reason == "explicit_env_model"
    assert routed["mapping_review"].model_id is None and not routed["mapping_review"].in_registry
    table = routing.assessment(spark).collect()
    assert {r.task for r in table} == schemas.VOCABULARIES["router_task"] and all(r.default_model and r.alternatives for r in table)


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 1, "w"), ("c", 0, "first"), (None, 0, "n")], "k string, seq int, v string")
    once = store.upsert(old, new, ["k"], "seq")
    assert {(r.k, r.v) for r in once.collect()} == {("a", "x"), ("b", "z"), ("c", "w"), (None, "n")}
    assert sorted(map(str, store.upsert(once, new, ["k"], "seq").collect())) == sorted(map(str, once.collect()))
    assert [(r.k, r.v) for r in store.insert_ignore(old, new, ["k"], "seq").collect()] == [("c", "first")]
    with pytest.raises(Exception, match="repeated key"):
        store.insert_strict(old, new, ["k"]).collect()


def test_packets_of_pages_need_no_shuffle_unless_a_page_repeats(spark):
    from tarnfold import workflow

    rows = [("r", 0, "one\n\n two \n\t\nthree"), ("r", 1, None), ("r", 2, " \n\t"), ("r", 3, ""), ("s", 0, "x"), (None, 5, "n\n"), ("t", None, "\nq\r\n")]
    for more in ([], [("s", 0, "again\nand"), (None, 5, "m")]):
        pages = spark.createDataFrame(rows + more, "report_id string, page_index int, native_text string")
        state = workflow.run_local(pages)
        want = evidence.packets(evidence.fragments(evidence.blocks(pages)))
        order = lambda df: sorted(map(str, df.select(*want.columns).collect()))
        assert order(state.packets) == order(want) and state.packets.count() == 4
        assert state.packets.schema["primary"].dataType.simpleString() == want.schema["primary"].dataType.simpleString()
        for df in (state.packets, state.disclosures):
            assert ("Exchange" in df._jdf.queryExecution().executedPlan().toString()) == bool(more)


def test_records_of_models_are_parsed_a_few_times_only(spark):
    df = spark.createDataFrame([('{"id": "a-vl", "raw": {"id": "a-vl", "name": "Kimi", "features": ["r1"]}}',), ('{"id": "b", "raw": {"id": "c", "name": "Kimi"}, "name": "glm-5"}',), ("{",), ('{"name": "none"}',)], "record string")
    caps = routing.capabilities(df)
    assert [(r.id, r.input_modalities, r.context_length, r.supports_reasoning) for r in caps.orderBy("id").collect()] == [("a-vl", ["text", "image"], 262_144, True), ("b", ["text"], 1_000_000, True)]
    # names were looked at mark by mark, and the record was parsed anew for each mark
    assert caps._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") < 60

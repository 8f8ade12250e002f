import base64
import io
import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tarnfold import cli, server, workflow
from tarnfold.sources import api, archives, files
from tarnfold.sources.report_store import ReportStore
from tarnfold.streaming import ledger as stream

# workers can't import this file: what is handed to them goes by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
BASE = "https://filings.example.org/api/filings"


def page(n, last):
    data = [{"id": f"{n}{k}", "attributes": {"fxo_id": f"L{k}-2022-12-31-ESEF-GB-{k}", "period_end": "2022-12-31", "sha256": "AB", "error_count": k, "package_url": f"/p/{n}{k}.zip"}, "relationships": {"entity": {"data": {"id": f"e{k}"}}}} for k in range(2)]
    included = [{"id": "e0", "type": "entity", "attributes": {"name": "Zero", "identifier": "LEI0"}}, {"id": "e1", "type": "other", "attributes": {"name": "No"}}]
    return {"data": data, "included": included, "links": {"next": None if last else f"{BASE}?n={n + 1}"}}


def fetch(url):
    n = int(url.rpartition("n=")[2]) if "n=" in url else 0
    return 200, {}, json.dumps(page(n, n == 2)).encode()


def test_api_pages(spark):
    rows = api.filings_from_api(spark, fetch, BASE, delay=0).collect()
    assert len(rows) == 6 and {r.package_url for r in rows} == {f"https://filings.example.org/p/{n}{k}.zip" for n in range(3) for k in range(2)}
    assert {(r.lei, r.entity_name) for r in rows} == {("LEI0", "Zero"), ("L1", None)} and {r.sha256 for r in rows} == {"ab"} and {r.country for r in rows} == {"GB"}
    assert len(api.filings_from_api(spark, fetch, BASE, max_pages=1, delay=0).collect()) == 2


def test_walk_ends_on_a_loop_and_retries():
    loop = lambda url: (200, {}, json.dumps({"links": {"next": BASE}}).encode())
    assert [(n, c) for n, _, c in api.walk_pages(loop, BASE, sleep=lambda s: None)] == [(0, True)]
    slept, calls = [], []

    def flaky(url):
        calls.append(url)
        return (429, {"Retry-After": "7"}, b"") if len(calls) == 1 else (503, {}, b"") if len(calls) == 2 else (200, {}, b"ok")

    assert api.fetch_again(flaky, "u", sleep=slept.append) == b"ok" and slept == [7.0, 3.0]
    with pytest.raises(OSError):
        api.fetch_again(lambda u: (404, {}, b""), "u", sleep=slept.append)
    assert slept == [7.0, 3.0]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_packages(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(**{"x.txt": "ESRS", "r.xhtml": "Total GHG emissions", "s.html": "no"}))
    (tmp_path / "b.zip").write_bytes(zipped(**{"r.html": "nothing", "z.html": "ESRS"}))
    (tmp_path / "c.zip").write_bytes(b"broken")
    (tmp_path / "d.zip").write_bytes(zipped(**{"x.txt": "ESRS"}))
    got = {r.file: (r.zip_ok, r.esg_flag) for r in archives.packages(spark, str(tmp_path)).collect()}
    assert got == {"a.zip": (True, 1), "b.zip": (True, 0), "c.zip": (False, 0), "d.zip": (True, 0)}


def test_csv_with_mark_ledger_and_settings(spark, tmp_path):
    (tmp_path / "i.csv").write_bytes("﻿lei,fiscal_year\nL1,2024\n,\n".encode())
    assert [tuple(r) for r in files.read_index(spark, str(tmp_path / "i.csv"), "lei string, fiscal_year int").collect()] == [("L1", 2024), (None, None)]
    entry = spark.createDataFrame([(1, "r", None, None, None, 2024, "f", 1.5, "fail", 0, "m")], files.schemas.LEDGER)
    for _ in range(2):
        files.append_ledger(entry, str(tmp_path / "l"))
    assert files.read_ledger(spark, str(tmp_path / "l")).count() == 2
    assert files.write_failures(entry, str(tmp_path / "f")) and not files.write_failures(entry.where("false"), str(tmp_path / "f"))
    assert files.read_ledger(spark, str(tmp_path / "f")).count() == 1
    with pytest.raises(ValueError, match="not unique"):
        files.require_unique(files.read_ledger(spark, str(tmp_path / "l")), ["report_id"])
    (tmp_path / ".env").write_text("# c\nA='x'\nB = 2 \nnothing\nC=\"q\"\n")
    assert files.settings(str(tmp_path / ".env"), {"B": "3", "C": ""}, {"D": "4", "A": "0"}) == {"A": "x", "B": "3", "C": "q", "D": "4"}


def test_models_and_uploads(spark, tmp_path):
    for name, body in (("a", {"models": [{"id": "m1"}, {"id": "m2"}]}), ("b", [{"id": "m3"}]), ("c", {"data": [{"id": "m4"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    got = files.read_models(spark, str(tmp_path / "*.json")).select(F.get_json_object("record", "$.id")).collect()
    assert sorted(r[0] for r in got) == ["m1", "m2", "m3", "m4"]
    up = spark.createDataFrame([("../a b.pdf", base64.b64encode(b"x").decode()), ("c", "%%%")], "name string, body string")
    assert [(r.file_name, r.content and bytes(r.content)) for r in files.decode_upload(up).collect()] == [("a_b.pdf", b"x"), ("c", None)]


def test_refresh_models(spark, tmp_path):
    path = f"file://{tmp_path}/models.json"
    assert api.refresh_models(lambda u: (200, {}, b'{"data": [{"id": "a"}, {"id": "b"}]}'), "u", path) == 2
    with pytest.raises(ValueError):
        api.refresh_models(lambda u: (200, {}, b'{"error": 1}'), "u", path)
    assert [r.ordinal for r in files.read_models(spark, f"{tmp_path}/models.json").collect()] == [0, 1]


def test_download_and_verify(spark, tmp_path):
    import hashlib

    good = hashlib.sha256(b"body").hexdigest()
    rows = spark.createDataFrame([("r1", "u1", "f1", good), ("r2", "u2", "f2", "00"), ("r3", "gone", "f3", None)], "report_id string, package_url string, file string, sha256 string")
    folder = str(tmp_path)

    def keep(name, body):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)

    out = {r.report_id: (r.ok, r.n_bytes) for r in api.download(rows, lambda u: (404, {}, b"") if u == "gone" else (200, {}, b"body"), keep, delay=0).collect()}
    assert out == {"r1": (True, 4), "r2": (False, 4), "r3": (False, 0)}
    assert [p.name for p in tmp_path.iterdir()] == ["f1"]


def reader(content):
    return [(t, 10.0, 20.0, "|" in t) for t in content.decode().split("\f")]


def documents(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "rep.v1.pdf").write_bytes("alpha\nbeta\f \f a | b | c".encode())
    return archives.documents(spark, str(tmp_path / "docs"), reader)


def test_workflow_store_and_service(spark, tmp_path):
    pages = documents(spark, tmp_path)
    assert {r.page_index: r.quality_flags for r in pages.collect()} == {0: [], 1: ["native_text_empty"], 2: ["table_candidate_detected"]}
    s = ReportStore(spark, str(tmp_path / "store"))
    assert s.listing().count() == 0
    for _ in range(2):  # a second run replaces the first
        s.save_state(workflow.run_local(pages), pages.select("report_id", "sha256").distinct())
    row = s.listing().first()
    assert (row.report_id, row.page_count, row.packet_count, row.disclosure_count, row.result_count) == ("rep.v1", 3, 2, 2, 0)
    answer = json.dumps(dict(choices=[dict(message=dict(content='{"disclosures": [{"raw_label": "x", "raw_text": "y", "evidence_ids": ["nope"]}]}'))]))
    cloud = workflow.run_cloud(pages, lambda model, prompt: answer, "m", str(tmp_path / "answers"), most=1)
    assert cloud.status == "cloud_pipeline_completed" and [r.quality_flags for r in cloud.disclosures.collect()] == [["cloud_candidate", "missing_valid_evidence_id"]]
    s.save_state(cloud)
    row = s.listing().first()
    assert (row.disclosure_count, row.result_count, row.models) == (1, 1, ["m"])
    ask = lambda *a: server.answer(spark, s, *a)
    assert ask("GET", "/api/reports", {})[1][0]["report_id"] == "rep.v1"
    assert len(ask("GET", "/api/reports/rep.v1", {})[1]["pages"]) == 3
    assert ask("GET", "/api/reports/none", {})[0] == 404 and ask("POST", "/api/run-local", {})[0] == 400 and ask("GET", "/x", {})[0] == 404
    assert len(ask("GET", "/api/model-assessment", {})[1]) == 9


def test_command_line(spark, tmp_path, capsys):
    raw = ",".join(c.split()[0] for c in files.schemas.RAW_FILING.split(", ")) + "\n"
    (tmp_path / "raw.csv").write_text(raw + "1,f1,L1,One,GB,ESEF,0,2022-12-31,2022,aa,0,0,0,2023,2023,http://p,,\n2,f2,L1,One,GB,ESEF,1,2022-12-31,2022,bb,1,0,0,2023,2023,http://q,,\n")
    assert cli.main(["index", str(tmp_path / "raw.csv"), str(tmp_path / "out")], spark) == 0
    assert capsys.readouterr().out.count("PASS") == 5
    assert cli.main(["sql", "SELECT report_id, n_versions FROM primary", "--table", str(tmp_path / "out" / "primary")], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"report_id": "R000001", "n_versions": 2}
    assert cli.main(["assessment"], spark) == 0


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"r{i * 7 % 5}", ["ok", "fail", "skip"][i % 3], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, report_id string, status string, esg_flag int")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    source = stream.entries(spark, str(tmp_path / "in"), df.schema, files_a_batch=2)
    q = stream.latest(source).writeStream.format("memory").queryName("latest_").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for r in rows:
        want[r[1]] = r
    assert {r.report_id: r.entry.seq for r in spark.table("latest_").collect()} == {k: r[0] for k, r in want.items()}

    def work(items):
        return items.select("report_id", "seq", F.when(F.col("report_id") == "r1", "fail").otherwise("ok").alias("status"))

    for _ in range(2):
        stream.process(stream.entries(spark, str(tmp_path / "in"), df.schema, files_a_batch=2), work, str(tmp_path / "done"), str(tmp_path / "state")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "done")).collect()
    good = [r.report_id for r in done if r.status == "ok"]
    assert sorted(good) == sorted(set(good)) == ["r0", "r2", "r3", "r4"] and sum(r.report_id == "r1" for r in done) >= 1


def test_store_keeps_other_reports_and_drops_what_a_failed_save_left(spark, tmp_path, monkeypatch):
    from tarnfold.sources import report_store

    for few in (10, 0):
        monkeypatch.setattr(report_store, "FEW_IDS", few)
        s = ReportStore(spark, str(tmp_path / f"few{few}"))
        rows = lambda *r: spark.createDataFrame(r, "report_id string, page_index int, native_text string")
        s.save("pages", rows(("a", 0, "a0"), ("b", 0, "b0"), ("b", 1, "b1"), (None, 0, "n")))
        rows(("z", 0, "left")).write.parquet(f"{s.root}/pages/v2/new")  # without a mark that it is complete
        assert {r.native_text for r in s.read("pages").collect()} == {"a0", "b0", "b1", "n"}
        s.save("pages", rows(("b", 0, "b2"), ("c", 0, "c0"), (None, 0, "m")))
        assert sorted(r.native_text for r in s.read("pages").collect()) == ["a0", "b2", "c0", "m", "n"]
        s.save("pages", rows(("c", 0, "c1")).where("false"))
        assert s.read("pages").count() == 5
        # new rows lie apart from kept ones: they were written as they came, in no shuffle with the old
        assert spark.read.parquet(f"{s.root}/pages/v2/new").count() == 3 and spark.read.parquet(f"{s.root}/pages/v2/kept").count() == 2


def test_store_reads_versions_without_parts_and_detail_takes_fields(spark, tmp_path):
    s = ReportStore(spark, str(tmp_path))
    spark.createDataFrame([("a", 1, "t1", None, None, ["f"]), ("a", 0, "t0", None, None, [])], files.schemas.PAGES).write.parquet(f"{s.root}/pages/v1")
    spark.createDataFrame([("a", None, None, 2, None, "{}")], files.schemas.REPORTS).write.parquet(f"{s.root}/reports/v1")
    assert s.read("pages").count() == 2
    assert [tuple(p) for p in s.detail("a").first().pages] == [(0, "t0", []), (1, "t1", ["f"])]
    assert [tuple(p) for p in s.detail("a", pages=["page_index"]).first().pages] == [(0,), (1,)]


def test_pages_of_a_long_walk_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(api, "BATCH_CHARS", 50)
    walk = [(n, str(n) * 20, n == 9) for n in range(10)]
    batches = list(api.page_batches(iter(walk)))
    assert [b.num_rows for b in batches] == [3, 3, 3, 1] and [tuple(r.values()) for b in batches for r in b.to_pylist()] == walk
    assert list(api.page_batches(iter([]))) == []
    reader = api.page_source(fetch)({"base": BASE, "delay": "0"}).reader(None)
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 3


def test_many_files_are_few_tasks(spark, tmp_path):
    import hashlib

    for k in range(300):
        (tmp_path / f"s{k % 7}" / "t").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"s{k % 7}" / "t" / f"n {k}.v.pdf").write_bytes(f"{k}\f|".encode())
    for name in ("top.pdf", "_no.pdf", ".no.pdf", "a.gz", "none"):
        (tmp_path / name).write_bytes(b"" if name == "none" else b"x")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.pdf").write_bytes(b"x")
    got = archives.documents(spark, str(tmp_path), reader)
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism  # binaryFile made a task of every 32 files
    assert sorted((r.report_id, r.page_index, r.native_text) for r in got.collect()) == sorted([("top", 0, "x"), *((f"n {k}.v", i, t) for k in range(300) for i, t in enumerate((str(k), "|")))])
    held = {r.file: (r.size, r.actual_sha) for r in files.inventory(spark, f"file://{tmp_path}").collect()}
    assert len(held) == 303 and held["a.gz"] == (1, hashlib.sha256(b"x").hexdigest()) and held["none"][0] == 0
    assert files.inventory(spark, str(tmp_path / "s*" / "t")).count() == 300 and files.inventory(spark, str(tmp_path / "top.pdf")).count() == 1
    with pytest.raises(FileNotFoundError):
        files.inventory(spark, str(tmp_path / "gone"))

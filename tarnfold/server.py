"""A small JSON service over the report store: lists, details, the model table, and local runs."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from . import workflow
from .operators import routing
from .sources import api, archives
from .sources.report_store import ReportStore


JSON = "application/json; charset=utf-8"


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def answer(spark: SparkSession, store: ReportStore, method: str, path: str, body: dict) -> tuple[int, object]:
    """(status, JSON) of a request; whatever goes wrong in a POST is the caller's 400."""
    parts = [p for p in path.partition("?")[0].split("/") if p]
    if method == "GET":
        if parts in ([], ["api"]):
            return 200, {"steps": workflow.steps(), "paths": ["/api/reports", "/api/reports/ID", "/api/model-assessment", "/api/run-local", "/api/run-cloud", "/api/refresh-models"]}
        if parts == ["api", "model-assessment"]:
            return 200, _rows(routing.assessment(spark))
        if parts == ["api", "reports"]:
            return 200, _rows(store.listing())
        if parts[:2] == ["api", "reports"] and len(parts) == 3:
            found = _rows(store.detail(parts[2]))
            return (200, found[0]) if found else (404, {"error": "no such report"})
    if method == "POST" and parts in (["api", "run-cloud"], ["api", "refresh-models"]):
        try:
            if parts[1] == "refresh-models":
                return 200, {"models": api.refresh_models(api.http_fetch, body["url"], body["path"])}
            pages = archives.documents(spark, body["path"])
            state = workflow.run_cloud(pages, api.http_completer(body["url"], body.get("token")), body["model"], f"{store.root}/answers", int(body.get("start", 0)), int(body.get("most", 10)))
            store.save_state(state, pages.select("report_id", "sha256").distinct())
            return 200, {"status": state.status, "steps": workflow.steps(completed=True, api_completed=True), "disclosures": state.disclosures.count()}
        except Exception as e:  # noqa: BLE001
            return 400, {"error": str(e)[:500]}
    if method == "POST" and parts == ["api", "run-local"]:
        try:
            pages = archives.documents(spark, body["path"])
            state = workflow.run_local(pages)
            store.save_state(state, pages.select("report_id", "sha256").distinct())
            return 200, {"status": state.status, "steps": workflow.steps(completed=True), "disclosures": state.disclosures.count()}
        except Exception as e:  # noqa: BLE001
            return 400, {"error": str(e)[:500]}
    return 404, {"error": "no such path"}


def serve(spark: SparkSession, store: ReportStore, host: str, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, out = answer(spark, store, method, self.path, body)
            except ValueError as e:
                status, out = 400, {"error": str(e)}
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in (("Content-Length", str(len(data))), ("Content-Type", JSON)):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._do("GET")

        def do_POST(self) -> None:
            self._do("POST")

    ThreadingHTTPServer((host, port), Handler).serve_forever()

"""A paginated JSON API as a Spark data source, and a fetcher with pacing and retries. The HTTP call itself is handed in."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import importable

PAGE_SIZE, DELAY = 200, 0.3
#: characters of bodies that a reader gathers before it hands them on; Spark's own batches are 10,000 pages
BATCH_CHARS = 4_000_000
RETRIES, BACKOFF, LONGEST_WAIT = 5, 1.5, 60.0
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
PAGE = (
    "struct<data:array<struct<id:string,attributes:struct<fxo_id:string,country:string,period_end:string,sha256:string,error_count:int,warning_count:int,inconsistency_count:int,processed:string,"
    "date_added:string,package_url:string,json_url:string,viewer_url:string>,relationships:struct<entity:struct<data:struct<id:string>>>>>,"
    "included:array<struct<id:string,type:string,attributes:struct<name:string,identifier:string>>>>"
)
#: (url) -> (status, headers, body)
Fetch = Callable[[str], tuple[int, dict, bytes]]


def http_fetch(url: str) -> tuple[int, dict, bytes]:
    """A Fetch over HTTP, by the standard library."""
    from urllib import error, request

    try:
        with request.urlopen(url, timeout=90) as r:  # noqa: S310 - the caller's URL
            return r.status, dict(r.headers), r.read()
    except error.HTTPError as e:
        return e.code, dict(e.headers), e.read()
    except error.URLError as e:
        raise OSError(f"{url}: {e.reason}") from e


def http_completer(url: str, token: str | None = None) -> Callable[[str, str], str]:
    """completer(model, prompt) for a chat service: the answer's body as it came."""

    def complete(model: str, prompt: str) -> str:
        from urllib import request

        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        with request.urlopen(request.Request(url, body, head), timeout=120) as r:  # noqa: S310
            return r.read().decode()

    return complete


def folder_store(folder: str) -> Callable[[str, bytes], None]:
    """store(name, body) that shows a file only when it is complete."""

    def store(name: str, body: bytes) -> None:
        import uuid

        from pyarrow import fs as pafs

        system, inner = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        part = f"{inner.rstrip('/')}/.{name}.{uuid.uuid4().hex}.part"
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(part) as out:
            out.write(body)
        system.move(part, f"{inner.rstrip('/')}/{name}")

    return store


def fetch_again(fetch: Fetch, url: str, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body, after as many tries as it takes: only statuses that may pass are tried again; Retry-After is honoured."""
    for k in range(retries):
        status, headers, body = fetch(url)
        if status < 400:
            return body
        if status not in RETRY_STATUS or k == retries - 1:
            raise OSError(f"{url}: status {status}")
        asked = {a.lower(): b for a, b in headers.items()}.get("retry-after")
        sleep(min(float(asked), LONGEST_WAIT) if asked and str(asked).isdigit() else min(BACKOFF * 2**k, LONGEST_WAIT))
    raise OSError(url)


def first_url(base: str, country: str | None = None) -> str:
    country = f"&filter[country]={country.upper()}" if country else ""
    return f"{base}?page[size]={PAGE_SIZE}&include=entity&sort=-processed{country}"


def walk_pages(fetch: Fetch, url: str, most: int | None = None, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, str, bool]]:
    """(number, body, whether it is the last of a complete walk). A URL that comes again ends the walk."""
    seen: set[str] = set()
    number = 0
    while url and url not in seen and (most is None or number < most):
        seen.add(url)
        body = fetch_again(fetch, url, sleep=sleep).decode()
        links = json.loads(body).get("links")
        url = links["next"] or "" if links and "next" in links else ""
        yield number, body, not url or url in seen
        number += 1
        if url:
            sleep(delay)


def page_batches(pages: Iterator[tuple[int, str, bool]]) -> Iterator:
    """The pages of a walk as Arrow batches, each of BATCH_CHARS characters and one body more at most, however long the walk is."""
    import pyarrow as pa

    schema = pa.schema([("page", pa.int32()), ("body", pa.string()), ("complete", pa.bool_())])
    held, chars = [], 0
    for row in pages:
        held.append(row)
        chars += len(row[1])
        if chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def page_source(fetch: Fetch, name: str = "filing_pages") -> type[DataSource]:
    """A data source class to register: options base, country, max_pages, delay; rows (page, body, complete).

    Each page names the next, so the walk is one task; with option countries, a comma-separated list, each country is a task of its own.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [InputPartition(c.strip() or None) for c in self.options.get("countries", self.options.get("country", "")).split(",")]

        def read(self, partition):
            most = self.options.get("max_pages")
            yield from page_batches(walk_pages(fetch, first_url(self.options["base"], partition.value), int(most) if most else None, float(self.options.get("delay", DELAY))))

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "page int, body string, complete boolean"

        def reader(self, schema):
            return Reader(self.options)

    return Source


def filings_from_api(spark: SparkSession, fetch: Fetch, base: str, countries: list[str] | None = None, max_pages: int | None = None, delay: float = DELAY) -> DataFrame:
    """Raw filings of all pages, with `complete` telling whether the walk reached the end."""
    from pyspark.sql import functions as F

    from ..operators.index import flatten_page

    source = page_source(fetch)
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("base", base).option("countries", ",".join(countries or [""])).option("delay", str(delay))
    pages = (reader.option("max_pages", str(max_pages)) if max_pages else reader).load()
    parsed = pages.select("complete", F.from_json("body", PAGE).alias("p")).select("complete", "p.data", "p.included")
    return flatten_page(parsed, base.split("/api/")[0])


def download(wanted: DataFrame, fetch: Fetch, store: Callable[[str, bytes], None], delay: float = 0.4) -> DataFrame:
    """Outcomes (report_id, file, n_bytes, actual_sha, ok, existed, msg) of fetching package_url and storing it as file, if the hash is the expected one.

    Rows are fetched one after another in each partition: repartition to the number of connections that the server allows.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, url, file, sha in zip(b["report_id"], b["package_url"], b["file"], b["sha256"]):
                try:
                    body = fetch_again(fetch, url)
                    got = hashlib.sha256(body).hexdigest()
                    ok = not sha or got == str(sha).lower()
                    if ok:
                        store(file, body)
                    rows.append((r, file, len(body), got, ok, False, "" if ok else "hash differs"))
                except OSError as e:
                    rows.append((r, file, 0, None, False, False, str(e)))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["report_id", "file", "n_bytes", "actual_sha", "ok", "existed", "msg"])

    importable(wanted.sparkSession)
    return wanted.select("report_id", "package_url", "file", "sha256").mapInPandas(run, "report_id string, file string, n_bytes long, actual_sha string, ok boolean, existed boolean, msg string")


def complete_tasks(tasks: DataFrame, completer: Callable[[str, str], str]) -> DataFrame:
    """(request_id, report_id, model_id, task_type, response, latency_ms) from completer(model_id, prompt) for each task; limit tasks before, as no limit moves below this."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, took = [], []
            for m, p in zip(b["model_id"], b["prompt"]):
                began = time.perf_counter()
                out.append(completer(m, p))
                took.append((time.perf_counter() - began) * 1000)
            yield b.drop(columns="prompt").assign(response=out, latency_ms=took)

    importable(tasks.sparkSession)
    rows = tasks.select("request_id", "report_id", "model_id", "task_type", "prompt")
    return rows.mapInPandas(run, "request_id string, report_id string, model_id string, task_type string, response string, latency_ms double")


def refresh_models(fetch: Fetch, url: str, path: str) -> int:
    """Fetch the list of models and keep it at path for read_models; the number of models. The old list stays if the new one is no JSON list."""
    from pyarrow import fs as pafs

    body = fetch_again(fetch, url)
    listed = json.loads(body)
    listed = listed.get("data", listed.get("models")) if isinstance(listed, dict) else listed
    if not isinstance(listed, list):
        raise ValueError(f"{url} holds no list of models")
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_output_stream(inner) as out:
        out.write(json.dumps({"models": listed}, ensure_ascii=False).encode())
    return len(listed)

"""Reports, packets, disclosures and results as Parquet tables below one folder; a run replaces what an earlier one left for its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import store

#: up to so many replaced reports, their ids go to all tasks; of more, the old rows are shuffled to them
FEW_IDS = 500_000
TABLES = {"reports": schemas.REPORTS, "pages": schemas.PAGES, "packets": schemas.PACKETS, "disclosures": schemas.DISCLOSURES, "results": schemas.RESULTS}


class ReportStore:
    """Each save writes a new version of a table beside the old one; readers take the newest that is complete, writers are one at a time.

    A version is the folder `new`, of the rows that were saved, and `kept`, of the old rows of other reports; its own _SUCCESS is written after both. New rows are computed once and not shuffled, and old ones aren't
    shuffled unless more than FEW_IDS reports are replaced.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self, table: str) -> list[int]:
        fs, path = self._folder(f"{self.root}/{table}")
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and fs.exists(p.suffix("/_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        have = self._versions(table)
        if not have:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).option("recursiveFileLookup", "true").parquet(f"{self.root}/{table}/v{have[-1]}")

    def save(self, table: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], TABLES[table])
        shaped = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.dtypes))
        have = self._versions(table)
        to = f"{self.root}/{table}/v{(have or [0])[-1] + 1}"
        fs, path = self._folder(to)
        fs.delete(path, True)  # what a save that failed has left
        shaped.write.parquet(f"{to}/new")
        if have:
            ids = self.spark.read.schema(TABLES[table]).parquet(f"{to}/new").select("report_id").distinct()
            ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
            store.other_reports(self.read(table), ids).select(*columns.columns).write.parquet(f"{to}/kept")
        fs.create(path.suffix("/_SUCCESS")).close()

    def save_state(self, state, sources: DataFrame | None = None) -> None:
        """Everything that a workflow run has made. sources: report_id, artifact_path, sha256."""
        page = F.struct(*(c for c in ("page_index", "width", "height", "quality_flags") if c in state.pages.columns))
        document = F.to_json(F.struct("report_id", F.array_sort(F.collect_list(page)).alias("pages")))
        counted = state.pages.groupBy("report_id").agg(F.count("*").cast("int").alias("page_count"), F.current_timestamp().alias("created_at"), document.alias("document_json"))
        self.save("reports", counted if sources is None else counted.join(sources, "report_id", "left"))
        self.save("pages", state.pages)
        for name in ("packets", "results", "disclosures"):
            rows = getattr(state, name)
            if rows is not None:
                self.save(name, rows)

    def listing(self) -> DataFrame:
        return store.listing(self.read("reports"), self.read("packets"), self.read("disclosures"), self.read("results"))

    def detail(self, report_id: str, **fields: list[str]) -> DataFrame:
        """One report with its children. fields: for a child, those of its columns that are wanted; a report's rows of a child meet in one row, so that leaving its texts out saves much."""
        children = {
            "pages": (self.read("pages"), ["page_index", "native_text", "quality_flags"]),
            "disclosures": (self.read("disclosures"), ["disclosure_id", "disclosure_type", "raw_label", "raw_text", "evidence_ids", "quality_flags"]),
            "results": (self.read("results"), ["request_id", "model_id", "task_type"]),
        }
        children |= {name: (children[name][0], [c for c in children[name][1] if c in wanted]) for name, wanted in fields.items()}
        return store.detail(self.read("reports"), children, report_id)

"""Tables as files: index and ledger CSV, model lists, settings; overwrite, append and failure-list sinks."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: text that a task of over_files gathers before it hands rows on
BATCH_BYTES = 4_000_000


def read_index(spark: SparkSession, path: str, schema: str = schemas.PRIMARY_FILING) -> DataFrame:
    """CSV with a header, byte-order mark or not; columns as the schema types them, '' as NULL."""
    return spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').schema(schema).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.LEDGER).csv(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append entries as new files; a file is seen when it is complete."""
    entries.write.mode("append").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition: tuple[str, ...] = ()) -> None:
    """Parquet, overwritten as a whole."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header, and the UTF-8 mark that spreadsheets want in front of it; read_index reads it either way."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_failures(ledger: DataFrame, path: str) -> bool:
    """Overwrite the list of failures only if there are any; whether there are."""
    failed = ledger.where("status = 'fail'")
    if failed.isEmpty():
        return False
    write_csv(failed, path)
    return True


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error that names a key which occurs twice; for loads that must not drop rows."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").first()
    if bad:
        raise ValueError(f"{', '.join(keys)} is not unique: {[bad[k] for k in keys]} occurs {bad['n']} times")
    return df


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, record): JSON records of a model list, which is {"models": [...]}, {"data": [...]} or a bare list."""
    text = spark.read.option("wholetext", True).text(path)
    listed = F.coalesce(F.get_json_object("value", "$.models"), F.get_json_object("value", "$.data"), F.col("value"))
    return text.select(F.posexplode(F.variant_get(F.try_parse_json(listed), "$", "array<variant>")).alias("ordinal", "v")).select("ordinal", F.to_json("v").alias("record"))


def write_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").json(path)


_SETTING = re.compile(r"\s*(?P<key>[^#\s=][^=\s]*)\s*=\s*(?P<value>.*?)\s*$")


def settings(path: str | None = None, environ: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines with comments and quotes; the environment wins over the file, the file over defaults."""
    found = dict(defaults or {})
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                if m := _SETTING.match(line):
                    found[m["key"]] = m["value"].strip("\"'")
    env = os.environ if environ is None else environ
    return found | {k: env[k] for k in list(found) + [k for k in env if k.startswith("TARNFOLD_")] if env.get(k)}


def decode_upload(uploads: DataFrame, body: str = "body", name: str = "name") -> DataFrame:
    """Uploaded base64 bodies as bytes under a safe name; bodies that aren't base64 become NULL."""
    from ..functions.expr import safe_upload_name

    return uploads.withColumn("content", F.try_to_binary(body, F.lit("base64"))).withColumn("file_name", safe_upload_name(F.col(name))).drop(body)


def _units(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """(root of the file system, paths that tasks share out): the files of a folder, or those that a pattern names, and subfolders as wholes. Only the top is listed here."""
    from pyarrow import fs as pafs

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tops = [t.getPath().toUri() for t in system.globStatus(path) or []]
    if not tops:
        raise FileNotFoundError(folder)
    root = f"{tops[0].getScheme()}://{tops[0].getAuthority() or ''}/"
    system, found = pafs.FileSystem.from_uri(root)[0], []
    for top in tops:
        info = system.get_file_info(top.getPath())
        found += [f.path for f in system.get_file_info(pafs.FileSelector(info.path)) if _seen(f.base_name)] if info.type == pafs.FileType.Directory else [info.path]
    return root, found


def _seen(name: str) -> bool:
    """Whether Spark would read a file or folder of this name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def over_files(spark: SparkSession, folder: str, rows: Callable[[str, bytes], Iterable[tuple]], schema: str, glob: str = "*") -> DataFrame:
    """The rows that rows(name, content) makes of every file below a folder.

    A task lists and reads its share of the folder's files and subfolders one after the other, so that the number of tasks doesn't grow with that of files, and contents stay in it; rows leave in small batches.
    """
    from ..runtime import importable

    root, units = _units(spark, folder)
    columns = spark.createDataFrame([], schema).columns

    def paths(system, unit: str) -> Iterator[str]:
        from pyarrow import fs as pafs

        info = system.get_file_info(unit)
        below = system.get_file_info(pafs.FileSelector(unit, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        for f in below:
            if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob) and all(map(_seen, f.path[len(unit) :].split("/"))):
                yield f.path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        system, held, size = pafs.FileSystem.from_uri(root)[0], [], 0
        for unit in (u for b in batches for u in b["unit"]):
            for path in paths(system, unit):
                with system.open_input_stream(path, compression=None) as f:
                    content = f.read()
                for row in rows(path.rpartition("/")[2], content):
                    held.append(row)
                    size += 100 + sum(len(x) for x in row if isinstance(x, str))
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(held, columns=columns)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    importable(spark)
    tasks = max(1, min(len(units), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(u,) for u in units], "unit string").repartition(tasks).mapInPandas(run, schema)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, actual_sha) of every file below a folder, hashed where it lies."""
    return over_files(spark, folder, lambda name, content: [(name, len(content), hashlib.sha256(content).hexdigest())], "file string, size long, actual_sha string")

"""What the operators share: scratch tables in the cluster's shared folder, free column names, small checks."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable

_number = itertools.count()
_SCAN_NODES = ("Relation", "Project", "Filter", "LogicalRelation", "SubqueryAlias", "View")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as spark.checkpoint.dir names it.

    Where it is unset, as in local tests, a temporary folder is made, set and removed at exit.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tarnfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tarnfold-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{next(_number):05d}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: computed once, and safe when executors go."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written_by_part(df: DataFrame, name: str) -> tuple[str, int]:
    """df, which has a column part, written such that read_part opens one small folder for each part: (path, number of folders)."""
    spark = df.sparkSession
    path, slots = scratch_path(spark, name), max(1, shuffle_width(spark))
    slotted = df.withColumn("slot", F.pmod("part", F.lit(slots)))
    slotted.repartition(slots, "slot").sortWithinPartitions("slot", "part").write.partitionBy("slot").parquet(path)
    return path, slots


def read_part(where: tuple[str, int], part: int, schema: pa.Schema) -> pa.Table:
    """The rows of one part, in a task."""
    path, slots = where
    system, inner = pafs.FileSystem.from_uri(path)
    folder = f"{inner}/slot={part % slots}"
    if system.get_file_info(folder).type == pafs.FileType.NotFound:
        return schema.empty_table()
    table = ds.dataset(folder, filesystem=system, format="parquet").to_table(columns=schema.names, filter=ds.field("part") == part)
    return table.cast(schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no DataFrame reads any more."""
    if not path.startswith(scratch_root(spark)):
        raise ValueError(f"{path} is not a scratch table")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; DataFrames that read them can't be used afterwards."""
    remove(spark, scratch_root(spark))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it, such that df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def is_plain_scan(df: DataFrame) -> bool:
    """Whether each partition of df is a fixed piece of files, so that a second scan yields the same partitions (see pin_scans)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-!'").split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()]
    return bool(nodes) and all(n in _SCAN_NODES for n in nodes) and nodes[-1] in ("Relation", "LogicalRelation") and bool(df.inputFiles())


def pin_scans(spark: SparkSession) -> None:
    """Cut files by a fixed number for the rest of the session, and not by the cores that happen to be there when a scan starts.

    Without this, executors lost or gained between two scans of a table move rows to other partitions.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def need(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"column {c} is missing; there are {', '.join(df.columns)}")


def numbered(df: DataFrame, *columns: str) -> tuple:
    """df with its columns called c0, c1 and so on, and what the given ones are called now.

    Names that hold dots, or differ by case alone, can then do no harm; toDF(*df.columns) gives them back.
    """
    need(df, *columns)
    importable(df.sparkSession)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), *(f"c{df.columns.index(c)}" for c in columns)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

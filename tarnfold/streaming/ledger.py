"""The ledger as a stream: latest state, counters, resumable processing. Each gives what the batch form gives for the same entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def entries(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind).load(folder)


def latest(stream: DataFrame, key: str = "report_id", seq: str = "seq") -> DataFrame:
    """The last entry of each item so far: one state row a key, whatever order entries come in; for update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("entry"))


def counters(stream: DataFrame) -> DataFrame:
    return stream.groupBy("status").agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by status and time window; entries later than `late` are dropped, and a window's row appears once, when it is over."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), "status").agg(F.count("*").alias("n"))


def once(stream: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Entries without those that repeat a key within the time that state is kept for."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, key: str = "report_id", trigger: dict | None = None) -> StreamingQuery:
    """Run work on items without a good outcome in the ledger at folder, and write each batch's outcomes there under the batch's number.

    A batch that is repeated after a loss overwrites its own outcomes, so that each counts once. Stop it with the query's stop().
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        todo = df.dropDuplicates([key])
        if fs.exists(path) and fs.listStatus(path):
            done = spark.read.parquet(folder).where((F.col("batch") != number) & F.col("status").isin("ok", "skip"))
            todo = todo.join(done.select(key), key, "left_anti")
        work(todo).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

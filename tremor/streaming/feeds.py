"""File-change and run-call feeds as Structured Streaming jobs over the batch operators."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators.runs import CALL_KEY, match_calls
from tremor.plans.loops import CutTable
from tremor.session import shared_folder

CHANGE = "path string, sha256 string, seq long, change string"


def file_changes(files: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of ``files`` whose hash differs from the path's row before, the first from ``last``.

    files: (path, sha256, seq); last: (path, sha256), the state before them. Rows are dealt out by range of (path,
    seq), so a busy path is spread over tasks; only one row for each range of a path meets the next range. Rows of one
    path with equal ``seq`` are taken in order of their hash.
    """
    order = ["seq", "sha256"]
    dealt = CutTable(files.select("path", "sha256", "seq").repartitionByRange("path", *order).withColumn("_part", F.spark_partition_id())).df
    ends = dealt.groupBy("path", "_part").agg(F.max_by("sha256", F.struct(*order)).alias("end"))
    before = Window.partitionBy("path").orderBy("_part")
    known = last.select("path", F.col("sha256").alias("_last"))
    opened = ends.withColumn("_before", F.lag("end").over(before)).join(known, "path", "left").select("path", "_part", F.coalesce("_before", "_last").alias("_open"))
    own = F.lag("sha256").over(Window.partitionBy("path", "_part").orderBy(*order))
    rows = dealt.withColumn("_own", own).join(opened, ["path", "_part"]).withColumn("_previous", F.coalesce("_own", "_open"))
    return rows.where(~F.col("sha256").eqNullSafe(F.col("_previous"))).select(
        "path", "sha256", "seq", F.when(F.col("_previous").isNull(), "added").otherwise("modified").alias("change"))


def stream_file_changes(files: DataFrame, out: str, checkpoint: str | None = None) -> None:
    """Store a file's row only when its hash differs from the last one seen. files: stream of (path, sha256, seq).

    Each micro-batch writes its changes and the last hash of the paths it saw; a replayed batch overwrites its own
    folders and reads only those of earlier ones. Batches must come in order of ``seq`` for each path; within one the
    rows may come in any order.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = CutTable(batch.select("path", "sha256", "seq")).df
        state = "path string, sha256 string, seq long, batch int"
        stored = spark.read.schema(state).parquet(f"{out}/last").where(F.col("batch") < batch_id) if batch_id else spark.createDataFrame([], state)
        last = stored.groupBy("path").agg(F.max_by("sha256", F.struct("batch", "seq", "sha256")).alias("sha256"))
        file_changes(rows, last).write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")
        ends = rows.groupBy("path").agg(F.max(F.struct("seq", "sha256")).alias("e")).select("path", "e.sha256", "e.seq")
        ends.write.mode("overwrite").parquet(f"{out}/last/batch={batch_id}")

    _run_batches(files, handle, checkpoint)


def read_file_changes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(f"{out}/changes").drop("batch")


def stream_distinct_calls(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each call once, with state bounded by the watermark. calls: stream with ts and the seven key columns."""
    return calls.where("caller <> callee").withWatermark("ts", delay).dropDuplicatesWithinWatermark(CALL_KEY)


def _run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None) -> None:
    spark = stream.sparkSession
    place = checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def stream_confirm(calls: DataFrame, edges: DataFrame, out: str, checkpoint: str | None = None) -> None:
    """Match each micro-batch of calls to the edges and store confirmations by batch.

    A replayed batch overwrites its own folder, so nothing is confirmed twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        match_calls(batch, edges)["matched"].write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run_batches(calls, handle, checkpoint)


def read_confirmations(spark, out: str) -> DataFrame:
    """One row per (edge, test) over all batches."""
    return spark.read.parquet(out).groupBy("edge_id", "test_id").agg(F.max("runtime_confidence").alias("runtime_confidence"))


def stream_refresh(files: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str | None = None) -> None:
    """Re-extract the repositories' changed files batch by batch. files: stream of (repo, path, content).

    Facts are stored per batch; the newest batch that saw a file owns its facts.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        extract(batch).withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/facts/batch={batch_id}")
        batch.select("repo", "path").distinct().withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/owners/batch={batch_id}")

    _run_batches(files, handle, checkpoint)


def read_refreshed(spark, out: str) -> DataFrame:
    owners = spark.read.parquet(f"{out}/owners").groupBy("repo", "path").agg(F.max("batch_no").alias("batch_no"))
    return spark.read.parquet(f"{out}/facts").drop("batch").join(owners, ["repo", "path", "batch_no"], "left_semi").drop("batch_no")

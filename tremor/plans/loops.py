"""Helpers for bounded iterative jobs: lineage cuts, emptiness tests, global numbering."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.session import shared_folder, sized


class CutTable:
    """A frame written to the shared folder; ``df`` reads it back with a short plan.

    Parquet rather than an RDD checkpoint: the next round's plan then knows the table's size (see ``sized``),
    so small frontiers are broadcast under Spark's own size limit and large ones shuffled.
    """

    def __init__(self, df: DataFrame):
        spark = sized(df.sparkSession)
        self.path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        spark = self.df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and continue from the stored table."""
    return CutTable(df).df


def global_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Number rows 1..n in global order without sorting them in a single task.

    Rows are range-partitioned and sorted per partition; only one count per partition is
    combined to give each partition its offset.
    """
    ranged = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(offsets, "_part")
        .withColumn(name, (F.col("_offset") + F.col("_pos") + 1).cast("long"))
        .drop("_part", "_pos", "_offset")
    )


def content_hash(df: DataFrame, *cols: str) -> tuple:
    """(row count, order-independent hash) of a frame; equal frames give equal pairs."""
    h = F.xxhash64(*[F.col(c) for c in (cols or df.columns)]).cast("decimal(20,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return row["n"], row["h"]

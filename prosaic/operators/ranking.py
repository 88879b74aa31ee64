"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosaic.sources.tables import saved


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number in the order, from 1. The order must have no ties that matter.

    Rows are range-partitioned and saved with their partition, so that it can't
    change when executors are lost, and then numbered in their partitions. One
    count per partition, summed on the driver, gives each one's first number.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = saved(dealt.withColumn("_part", F.spark_partition_id()), "ranked")
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    first, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(first)]
        first += counts[part]
    numbered = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    shift = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    return numbered.withColumn(name, (F.col(name) + shift).cast("bigint")).drop("_part")

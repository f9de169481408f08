"""Positions in a total order of a whole table, without gathering it in a task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of a partition are numbered in the lower bits of Spark's increasing ids.
_LOW = (1 << 33) - 1


def ordered(df: DataFrame, order: Sequence[Column], out: str = "position", partitions: int | None = None) -> DataFrame:
    """The rows with their gapless position, from 0, in an order, which should be total: rows that are equal in it get their positions as they come.

    The table is dealt by range of the order, sorted in each range and stored, as the ranges are sampled and another run might draw others. A range's first
    position is the number of rows in the ranges before it, a table of one row a range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    path = f"{shared_folder(spark)}/quillframe-ordered-{uuid.uuid4().hex}"
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(out, F.col("_first") + F.col("_id").bitwiseAND(_LOW)).drop("_part", "_first", "_id")

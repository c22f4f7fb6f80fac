"""Places in a global order, found on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in the order of columns, from 0; of rows that are equal there any order.

    Rows are dealt over tasks by range and counted within each; only the sizes of the
    ranges meet in one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ahead = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, place).drop("_range", "_ahead")

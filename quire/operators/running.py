"""Running sums over one order of all rows, without one task that holds them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.lineage import checkpointed


def running_sum(rows: DataFrame, value: str, order: list, name: str, lots: int = 256) -> DataFrame:
    """rows with a column `name`: the sum of `value` over the rows before. Summed within ranges of the order, and then
    over the ranges, of which there are `lots` at most."""
    # Both uses below need the same ranges, and a second sample could draw others, so the first is kept.
    dealt = checkpointed(rows.repartitionByRange(lots, *order).withColumn("lot", F.spark_partition_id()))
    within = F.sum(value).over(Window.partitionBy("lot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    sums = dealt.groupBy("lot").agg(F.sum(value).alias("own"))
    ahead = sums.select("lot", (F.sum("own").over(Window.orderBy("lot")) - F.col("own")).alias("ahead"))
    return dealt.withColumn(name, within).join(F.broadcast(ahead), "lot").withColumn(name, F.col(name) + F.col("ahead")).drop("lot", "ahead")

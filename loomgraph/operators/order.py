"""Numbers and running sums over a whole table in order, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.shared import stored


def in_order(df: DataFrame, *order, value: str | None = None) -> DataFrame:
    """Add ``number``, from 1 in the given total order, and with ``value`` also ``before``, the sum of it over earlier rows.

    Rows are dealt by ranges of the order and numbered within each; ranges' counts and sums, one row a
    range, give what to add.
    """
    t = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    t = t.withColumn("_part", F.shiftright("_at", 33))
    total = F.sum(value) if value else F.lit(0)
    parts = t.groupBy("_part").agg(F.count("*").alias("_n"), total.alias("_s"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    out = t.join(F.broadcast(base), "_part").withColumn("number", F.col("_n0") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    if value:
        own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_s0") + F.coalesce(F.sum(value).over(own), F.lit(0)))
    return out.drop("_at", "_part", "_n0", "_s0")


def in_order_within(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Add ``number``, from 1 in order for each key. Rows are dealt by ranges of (key, order), so a key of very many rows is numbered by several tasks."""
    t = stored(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    t = t.withColumn("_part", F.shiftright("_at", 33))
    runs = t.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.withColumn("_n0", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select("_part", F.col(key).alias("_key"), "_first", "_n0")
    out = t.join(base.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn("number", F.col("_at") - F.col("_first") + F.col("_n0") + 1).drop("_at", "_part", "_p", "_key", "_first", "_n0")


def before_within(df: DataFrame, key: str, value: str, *order: str, tasks: int) -> DataFrame:
    """Add ``before``, the value of the row before for each key in a total order; null for its first row.

    Rows are dealt by ranges of (key, order) to ``tasks`` tasks, so a key of very many rows is spread; a range's last value of each key is handed to the next range that holds the key.
    """
    t = stored(df.repartitionByRange(tasks, key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    t = t.withColumn("_part", F.shiftright("_at", 33))
    ends = t.groupBy("_part", key).agg(F.max_by(value, "_at").alias("_last"))
    handed = ends.select(F.col("_part").alias("_p"), F.col(key).alias("_key"), F.lag("_last").over(Window.partitionBy(key).orderBy("_part")).alias("_handed"))
    own = Window.partitionBy("_part", key).orderBy("_at")
    near = t.repartition(tasks, "_part", key).withColumn("_nth", F.row_number().over(own)).withColumn("_own", F.lag(value).over(own))
    out = near.join(handed, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn("before", F.when(F.col("_nth") == 1, F.col("_handed")).otherwise(F.col("_own"))).drop("_at", "_part", "_p", "_key", "_handed", "_nth", "_own")

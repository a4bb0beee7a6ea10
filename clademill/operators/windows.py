"""Window operators along an ordered axis (sites, days)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smooth(df: DataFrame, value: str, keys: list[str], order: str, half: int = 2, out: str = "smoothed", least: int = 0) -> DataFrame:
    """Centred mean over `half` rows each way; the raw value in groups of fewer than `least` rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    mean = F.avg(value).over(w)
    if least:
        mean = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) < least, F.col(value)).otherwise(mean)
    return df.withColumn(out, mean)


def prefix_sum(df: DataFrame, value: str, keys: list[str], order: str, out: str = "prefix") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def neighbours(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"left_{column}": F.lag(column).over(w), f"right_{column}": F.lead(column).over(w)})


def islands(df: DataFrame, flag: Column, keys: list[str], position: str, gap: int = 1) -> DataFrame:
    """(keys, first, last, n): runs of flagged rows whose positions are at most `gap` apart."""
    w = Window.partitionBy(*keys).orderBy(position)
    hit = df.where(flag).withColumn("_new", (F.col(position) - F.lag(position).over(w) > gap).cast("int"))
    run = hit.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def close_pairs(df: DataFrame, keys: list[str], position: str, most: int) -> DataFrame:
    """Rows whose predecessor in the group is at most `most` positions before."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("previous", F.lag(position).over(w)).where(F.col(position) - F.col("previous") <= most)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps only k rows a group and task before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def leave_one_out(df: DataFrame, value: str, keys: list[str], out: str = "others") -> DataFrame:
    """Mean of the other rows of the group; null for a row that is alone."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn(out, F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1)))


def z_score(df: DataFrame, value: str, keys: list[str], out: str = "z") -> DataFrame:
    """Distance from the group's mean in population standard deviations; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))

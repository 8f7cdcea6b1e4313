"""Dashboard expressions over metric series (metric, labels..., ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate(series: DataFrame, by: list[str], window_s: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Increase per second over the last ``window_s`` seconds of each counter; a fall counts as a restart from 0."""
    w = Window.partitionBy(*by).orderBy(ts)
    before = F.lag(value).over(w)
    grown = series.withColumn("_d", F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before).cast("double"))
    total = F.sum("_d").over(w.rangeBetween(-window_s + 1, 0))
    return grown.withColumn("rate", total / window_s).drop("_d")


def top_k(rows: DataFrame, k: int, value: str, *ties: str, ts: str = "ts") -> DataFrame:
    """The k largest at each time. Series are few at any one time; the window's groups are the times."""
    n = F.row_number().over(Window.partitionBy(ts).orderBy(F.col(value).desc(), *ties))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def ratio(a: DataFrame, b: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """a / b of series with equal labels and time."""
    right = b.select(*by, ts, F.col("value").alias("_b"))
    return a.join(right, [*by, ts]).select(*by, ts, F.try_divide("value", "_b").alias("value"))


def total(rows: DataFrame, value: str, *by: str, ts: str = "ts") -> DataFrame:
    return rows.groupBy(ts, *by).agg(F.sum(value).alias(value))

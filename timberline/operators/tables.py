"""The relational tables of a parsed log: ``process``, ``tableUse`` and ``events``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.correlate import Options, correlate, records_of
from timberline.plans import schemas as S


@dataclass
class Tables:
    process: DataFrame
    table_use: DataFrame
    events: DataFrame

    def register(self) -> None:
        """As temporary views, for SQL."""
        self.process.createOrReplaceTempView("process")
        self.table_use.createOrReplaceTempView("tableUse")
        self.events.createOrReplaceTempView("events")


def first_rows(df: DataFrame, key: list[str], order: str = "emitted") -> DataFrame:
    """Of the rows with equal keys, the one that was output first; the loader's keys drop the others."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def build_tables(parsed: DataFrame) -> Tables:
    """Tables of ``correlate`` output. All carry log_id, which belongs to each key."""
    commands = parsed.where(F.col("command").isNotNull()).select("log_id", "emitted", "command.*")
    commands = first_rows(commands, ["log_id", "processkey", "lineNumber"])
    process = commands.select("log_id", *S.PROCESS_COLUMNS)
    table_use = commands.select("log_id", "processkey", "lineNumber", F.explode("tables").alias("t")).select("log_id", "processkey", "lineNumber", "t.*")
    events = first_rows(parsed.where(F.col("event").isNotNull()).select("log_id", "emitted", "event.*"), ["log_id", "lineNumber"]).select("log_id", *S.EVENT_COLUMNS)
    return Tables(process, table_use, events)


def parse_log(lines: DataFrame, options: Options | None = None) -> DataFrame:
    """Lines to the output of the correlation."""
    return correlate(records_of(lines), options)

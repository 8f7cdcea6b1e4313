"""The driver's queries over the bound tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.plans import binding, more_queries
from timberline.plans.example_oracles import example_oracles
from timberline.plans.examples import EXAMPLES, Question
from timberline.plans.report_oracles import report_oracles
from timberline.plans.reports import REPORT, LogTables, Thresholds

#: Lower than a report's own, so that the small tables show something.
THRESHOLDS = Thresholds(lock_ms=1000)


def bound_tables(spark: SparkSession, sf_dir: str) -> LogTables:
    return LogTables(*(f(spark, sf_dir) for f in (binding.process, binding.table_use, binding.events, binding.proxy)))


def _report(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: REPORT[name][2](bound_tables(spark, sf_dir), THRESHOLDS)


def _example(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: EXAMPLES[name](bound_tables(spark, sf_dir), Question())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _report(name) for name in REPORT} | {name: _example(name) for name in EXAMPLES} | more_queries.QUERIES
ORACLES: dict[str, str] = report_oracles(THRESHOLDS.lock_ms) | example_oracles(Question()) | more_queries.ORACLES

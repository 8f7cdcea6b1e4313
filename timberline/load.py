"""The loader: log files to tables, SQL text, JSON lines, metrics, lock pages or pending commands.

``python -m timberline.load LOG... --out DIR [--to tables sql json metrics locks pending]``, or with ``--proxy`` for the logs
of a proxy. Run it with spark-submit on a cluster; a session is taken as it is found.
"""

from __future__ import annotations

import argparse
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from timberline.operators.correlate import Options
from timberline.operators.tables import build_tables, parse_log
from timberline.plans import locks, metrics, proxy
from timberline.sources import logs, sinks

KINDS = ("tables", "sql", "json", "metrics", "locks", "pending")
PROXY_KINDS = {"tables": "parquet", "sql": "sql", "json": "json"}


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="timberline.load", description="Loads server logs.")
    p.add_argument("logs", nargs="+", help="log files in the order of their lines; .gz too")
    p.add_argument("--out", required=True, help="folder to write")
    p.add_argument("--to", nargs="+", choices=KINDS, default=["tables"], help="what to write")
    p.add_argument("--proxy", action="store_true", help="the logs are those of a proxy")
    p.add_argument("--gzip-by-content", action="store_true", help="find gzip files by their first bytes, not by name")
    p.add_argument("--log-id", default="log", help="name of the log that the files make up")
    p.add_argument("--max-line", type=int, default=logs.MAX_LINE, help="bytes of a line that are kept")
    p.add_argument("--output-every", type=float, default=1.0, help="least seconds of log time between two flushes")
    p.add_argument("--no-completion-records", action="store_true", help="the log has no completed records; flush by start time")
    p.add_argument("--server-id", default="", help="label of the metrics")
    p.add_argument("--lock-ms", type=int, default=10_000, help="waits and holds longer than that are lock records")
    p.add_argument("--exclude", default="", help="pattern of tables without lock records")
    found = p.parse_args(args)
    if found.proxy and (wrong := set(found.to) - PROXY_KINDS.keys()):
        p.error(f"not for proxy logs: {' '.join(sorted(wrong))}")
    return found


def load_lines(spark: SparkSession, lines: DataFrame, a: argparse.Namespace) -> None:
    """Writes what is asked for of lines (log_id, line_no, value), from whatever source they come.

    The parsed log is written to ``parsed`` first and read back from there, so a lost executor does not parse it again.
    """
    if a.proxy:
        rows = proxy.parse_proxy(lines)
        for kind in a.to:
            sinks.write_proxy(rows, f"{a.out}/{kind}", PROXY_KINDS[kind])
        return
    parse_log(lines, Options(timedelta(seconds=a.output_every), a.no_completion_records)).write.mode("overwrite").parquet(f"{a.out}/parsed")
    parsed = spark.read.parquet(f"{a.out}/parsed")
    tables = build_tables(parsed)
    if "tables" in a.to:
        sinks.write_tables(tables, f"{a.out}/tables", "overwrite")
    if "sql" in a.to:
        sinks.write_sql(tables, f"{a.out}/sql")
    if "json" in a.to:
        sinks.write_json(parsed, f"{a.out}/json", "overwrite")
    if "metrics" in a.to:
        rows = metrics.snapshot(tables.process, tables.table_use, tables.events, metrics.MetricsConfig(server_id=a.server_id), lines=lines.count())
        metrics.prometheus_lines(rows).select("line").write.mode("overwrite").text(f"{a.out}/metrics")
    if "locks" in a.to:
        records = locks.lock_records(tables.process, tables.table_use, a.lock_ms, a.exclude)
        sinks.write_lock_pages(records, f"{a.out}/locks")
        sinks.write_csv(locks.lock_counts(tables.process, records), f"{a.out}/lock_counts")
    if "pending" in a.to:
        sinks.pending_json(locks.pending(tables.process)).write.mode("overwrite").text(f"{a.out}/pending")
        sinks.write_csv(locks.pending_counts(tables.process, tables.events), f"{a.out}/pending_counts")


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName("timberline.load").getOrCreate()
    read = logs.read_gzip_by_content if a.gzip_by_content else logs.read_lines
    load_lines(spark, read(spark, a.logs, a.log_id, a.max_line), a)


if __name__ == "__main__":
    main()

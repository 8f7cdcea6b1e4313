"""The administrator's report: named queries over ``process`` and ``tableUse``, in sections.

Each query is a function of the tables and the thresholds. Orders that the report leaves open end in keys, so a
limit has one result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSFERS = ("user-sync", "user-transmit")


@dataclass
class Thresholds:
    """Seconds, running commands, milliseconds and rows above which the report shows something."""

    long_command: float = 100
    long_sync: float = 500
    busy: int = 20
    lock_ms: int = 10_000
    top: int = 25


@dataclass
class LogTables:
    process: DataFrame
    table_use: DataFrame
    events: DataFrame | None = None
    proxy: DataFrame | None = None

    @cached_property
    def joined(self) -> DataFrame:
        """Table usage with its command, by key alone."""
        return self.table_use.drop("lineNumber").join(self.process, "processkey")


def bucket(time: str | Column, chars: int) -> Column:
    """The first characters of a time's text: 10 for days, 13 hours, 15 ten minutes, 16 minutes, 19 seconds."""
    return F.substring(F.date_format(time, "yyyy/MM/dd HH:mm:ss"), 1, chars)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _desc(c: str) -> Column:
    return F.col(c).desc()


def _counted(t: LogTables, n: int, *by: str) -> DataFrame:
    return top(t.process.groupBy(*by).agg(F.count("cmd").alias("num_cmds")), n, _desc("num_cmds"), *by)


def timerange(t, p):
    return t.process.agg(F.min("startTime").alias("start_time"), F.max("startTime").alias("end_time"))


def _long(t, above, transfers: bool):
    is_transfer = F.col("cmd").isin(*TRANSFERS)
    rows = t.process.where((F.col("completedLapse") > above) & (is_transfer if transfers else ~is_transfer))
    return rows.select("startTime", "endTime", "pid", "user", F.round("completedLapse").alias("lapse_s"), "running", "cmd", "args", "lineNumber").orderBy("endTime", "lineNumber")


def busy_periods(t, p):
    rows = t.process.groupBy(bucket("startTime", 16).alias("minute")).agg(F.max("running").alias("running"))
    return top(rows.where(F.col("running") > p.busy), p.top, "minute")


def memory_usage(t, p):
    rows = top(t.process, p.top, _desc("maxRss"), "lineNumber")
    waits = [F.round("completedLapse", 2).alias("lapse_s"), F.round("rpcRcv").alias("rpc_receive_wait_s"), F.round("rpcSnd").alias("rpc_send_wait_s")]
    return rows.select("pid", "user", "cmd", "app", *waits, "memMB", "memPeakMB", "uCpu", "sCpu", "startTime", "endTime")


def _cpu(t, p, by: str):
    rows = top(t.process, p.top, _desc(by), "lineNumber")
    waits = [F.round("completedLapse", 3).alias("lapse"), F.round("rpcRcv", 3).alias("rpc_receive_wait_s"), F.round("rpcSnd", 3).alias("rpc_send_wait_s")]
    return rows.select("pid", "user", "cmd", *waits, F.col("uCpu").alias("u_cpu_ms"), F.col("sCpu").alias("s_cpu_ms"), "startTime", "endTime")


def cpu_consumers(t, p):
    rows = t.process.where(~F.col("cmd").isin(*TRANSFERS))
    rows = rows.select("pid", "user", "cmd", F.round("completedLapse", 2).alias("lapse_s"), F.col("uCpu").alias("u_cpu_ms"), "startTime", "endTime", "args").distinct()
    return top(rows, 25, _desc("u_cpu_ms"), "pid", "startTime", "lapse_s")


def io_usage(t, p):
    pages = t.table_use.groupBy("processkey").agg(F.sum(F.col("pagesIn") + F.col("pagesOut")).alias("io_pages"))
    who = t.process.groupBy("processkey").agg(*(F.min(c).alias(c) for c in ("user", "cmd", "args")))
    return top(pages.join(who, "processkey").select("user", "cmd", "io_pages", "processkey", "args"), p.top, _desc("io_pages"), "processkey")


def read_write_pct(t, p):
    read, written = (F.coalesce(F.sum(c), F.lit(0)) for c in ("pagesIn", "pagesOut"))
    share = lambda x: F.round(F.try_divide(x * 100.0, read + written), 3)
    return t.table_use.agg(share(read).alias("read_pct"), share(written).alias("write_pct"))


def triggers(t, p):
    rows = t.joined.where(F.col("tableName").ilike("trigger_%")).groupBy(F.col("tableName").alias("trigger"), "cmd")
    return rows.agg(F.count("*").alias("num_triggers"), F.round(F.avg("triggerLapse"), 2).alias("avg_lapse"), F.round(F.max("triggerLapse"), 2).alias("max_lapse"))


def contention_summary(t, p):
    means = {"avg_read_locks": "readLocks", "avg_write_locks": "writeLocks", "avg_read_wait": "totalReadWait", "avg_read_held": "totalReadHeld", "avg_write_wait": "totalWriteWait", "avg_write_held": "totalWriteHeld"}
    sums = {"total_wait": F.col("totalReadWait") + F.col("totalWriteWait"), "total_held": F.col("totalReadHeld") + F.col("totalWriteHeld")}
    rows = t.table_use.groupBy("tableName").agg(F.count("readLocks").alias("num_read_locks"), *(F.round(F.avg(c)).alias(a) for a, c in means.items()), *(F.sum(c).alias(a) for a, c in sums.items()))
    return rows.where((F.col("total_wait") > p.lock_ms) & (F.col("total_held") > p.lock_ms)).orderBy(_desc("total_wait"))


_WHEN = ("startTime", "endTime", "lineNumber", "tableName")


def blocking_commands(t, p):
    held = (F.col("totalReadHeld") > p.lock_ms) | (F.col("totalWriteHeld") > p.lock_ms)
    internal = F.lit(False)
    for prefix in ("meta%", "clients%", "changes%"):
        internal |= F.col("tableName").ilike(prefix)
    rows = top(t.joined.where(held & ~internal), 30, *_WHEN)
    return rows.select("startTime", "endTime", "running", "user", "cmd", "pid", "tableName", "maxReadHeld", "totalReadHeld", "maxWriteHeld", "totalWriteHeld", "totalReadWait", "totalWriteWait")


def _blocking_by(t, by: str):
    rows = top(t.joined.where("completedLapse > 100"), 30, _desc(by), "lineNumber", "tableName")
    return rows.select("startTime", "endTime", "pid", "user", F.round("completedLapse").alias("lapse_s"), "running", "tableName", "totalReadHeld", "totalWriteHeld", "cmd", "args")


def blocked_commands(t, p):
    waited = (F.col("totalReadWait") > p.lock_ms) | (F.col("totalWriteWait") > p.lock_ms)
    rows = top(t.joined.where(waited), 30, *_WHEN)
    return rows.select("startTime", "endTime", F.round("computedLapse", 2).alias("computed_lapse_s"), "running", "user", "cmd", "pid", "tableName", "maxReadHeld", "maxWriteHeld", "totalReadWait", "totalWriteWait")


def worst_offenders(t, p):
    rows = t.joined.groupBy("user").agg(F.sum(F.col("maxReadHeld") + F.col("maxWriteHeld")).alias("held_ms"))
    return top(rows, p.top, _desc("held_ms"), "user")


def avg_wait(t, p):
    return t.table_use.agg(F.round(F.avg(F.col("totalReadWait") + F.col("totalWriteWait")), 2).alias("wait"))


def longest_phases(t, p):
    held, waited = F.max(F.col("totalReadHeld") + F.col("totalWriteHeld")), F.max(F.col("totalReadWait") + F.col("totalWriteWait"))
    phases = t.table_use.groupBy("processkey").agg(F.when(held > waited, held - waited).otherwise(held).alias("compute_ms"))
    who = t.process.groupBy("processkey").agg(*(F.min(c).alias(c) for c in ("user", "cmd", "startTime", "args")))
    return top(phases.join(who, "processkey").select("processkey", "user", "cmd", "startTime", "compute_ms", "args"), p.top, _desc("compute_ms"), "processkey")


def replication_times(t, p):
    rows = t.process.where("cmd = 'rmt-Journal'").groupBy(bucket("startTime", 15).alias("ten_minutes"), "user")
    lapse = "completedLapse"
    return rows.agg(F.count("cmd").alias("n"), F.min("cmd").alias("cmd"), F.round(F.max(lapse), 2).alias("max_time"), F.round(F.sum(lapse), 2).alias("total_time"), F.round(F.avg(lapse), 2).alias("average_time"))


Query = Callable[[LogTables, Thresholds], DataFrame]

#: Section, title and query by name, in the report's order.
REPORT: dict[str, tuple[str, str, Query]] = {
    "q01_timerange": ("basic", "First and last start", timerange),
    "q02_command_counts": ("basic", "Commands of each type", lambda t, p: _counted(t, p.top, "cmd")),
    "q03_commands_by_user": ("basic", "Commands of each type and user", lambda t, p: _counted(t, 30, "cmd", "user")),
    "q04_commands_by_app": ("basic", "Commands of each type and application", lambda t, p: _counted(t, 30, "cmd", "app")),
    "q05_long_commands": ("performance", "Long commands other than transfers", lambda t, p: _long(t, p.long_command, False)),
    "q06_long_sync_commands": ("performance", "Long transfers", lambda t, p: _long(t, p.long_sync, True)),
    "q07_busy_periods": ("performance", "Busy minutes", busy_periods),
    "q08_memory_usage": ("performance", "Most memory", memory_usage),
    "q09_cpu_system": ("performance", "Most system CPU", lambda t, p: _cpu(t, p, "sCpu")),
    "q10_cpu_user": ("performance", "Most user CPU", lambda t, p: _cpu(t, p, "uCpu")),
    "q11_cpu_consumers": ("performance", "Most user CPU other than transfers", cpu_consumers),
    "q12_io_usage": ("performance", "Most pages read and written", io_usage),
    "q13_read_write_pct": ("performance", "Share of pages read and written", read_write_pct),
    "q14_triggers": ("performance", "Trigger times", triggers),
    "q15_locks_contention_summary": ("locks", "Lock waits and holds by table", contention_summary),
    "q16_blocking_commands": ("locks", "Commands that held locks long", blocking_commands),
    "q17_blocking_read_commands": ("locks", "Long commands by read locks held", lambda t, p: _blocking_by(t, "totalReadHeld")),
    "q18_blocking_write_commands": ("locks", "Long commands by write locks held", lambda t, p: _blocking_by(t, "totalWriteHeld")),
    "q19_blocked_commands": ("locks", "Commands that waited long", blocked_commands),
    "q20_worst_offenders": ("locks", "Users by time of locks held", worst_offenders),
    "q21_avg_wait": ("locks", "Mean wait", avg_wait),
    "q22_longest_phases": ("compute", "Longest compute phases", longest_phases),
    "q23_replication_times": ("replication", "Replication times per ten minutes", replication_times),
}
SECTIONS = ("basic", "performance", "locks", "compute", "replication")


def run_report(tables: LogTables, thresholds: Thresholds | None = None, sections: tuple[str, ...] = SECTIONS) -> dict[str, DataFrame]:
    """The queries of the sections, by name; unknown sections raise."""
    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"no such section: {sorted(unknown)}")
    p = thresholds or Thresholds()
    return {name: query(tables, p) for name, (section, _, query) in REPORT.items() if section in sections}

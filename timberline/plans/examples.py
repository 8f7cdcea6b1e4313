"""Ad-hoc queries over the log tables: locks, load by time, commands by who ran them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.plans.reports import LogTables, bucket, top


@dataclass
class Question:
    """What the examples ask about."""

    lock_ms: int = 1000
    table: str = "integed"
    first: datetime = datetime(1995, 3, 1)
    last: datetime = datetime(1995, 6, 1)
    day_from: str = "10:00:00"
    day_to: str = "14:30:00"
    user: str = "User7"
    busy: int = 20
    slow_s: float = 400


#: Argument shapes of integrations, each counted.
INTEGRATION_SHAPES = ("^-b", "^-S //", "^-Rb //", "^-f //", "^-c [0-9]+", "-n$", "^$", "-r", "//depot", "@[0-9]+,@[0-9]+")

_LOCK = ("startTime", "endTime", "computedLapse", "running", "cmd", "pid", "tableName", "maxReadHeld", "maxWriteHeld", "totalReadWait", "totalWriteWait")


def _over(columns: tuple[str, ...], ms: int) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c) > ms)
    return out


_READ_WRITE_HELD, _READ_WRITE_WAIT = ("totalReadHeld", "totalWriteHeld"), ("totalReadWait", "totalWriteWait")


def _locks(columns: tuple[str, ...], *shown: str) -> Callable:
    return lambda t, q: t.joined.where(_over(columns, q.lock_ms)).select(*(shown or _LOCK)).orderBy("startTime", "endTime")


def _period(q: Question, time: str = "startTime") -> Column:
    return F.col(time).between(q.first, q.last)


#: Aggregates by short name.
_AGGREGATES = {"n": "count(*)", "total": "sum(completedLapse)", "mean": "round(avg(completedLapse), 3)", "most": "max(completedLapse)", "running": "max(running)"}


def _lapse(*names: str) -> list[Column]:
    return [F.expr(_AGGREGATES[n]).alias(n) for n in names]


def _per(chars: int, *names: str, where=None, also: tuple[str, ...] = ()) -> Callable:
    def query(t: LogTables, q: Question) -> DataFrame:
        rows = t.process.where(where(q)) if where else t.process
        return rows.groupBy(bucket("startTime", chars).alias("time"), *also).agg(*_lapse(*names)).orderBy("time", *also)

    return query


def x04(t, q):
    h, w = F.max(F.col("totalReadHeld") + F.col("totalWriteHeld")), F.max(F.col("totalReadWait") + F.col("totalWriteWait"))
    phases = t.table_use.groupBy("processkey").agg((h - w).alias("compute_ms"))
    return top(phases, 25, F.col("compute_ms").desc(), "processkey")


def x07(t, q):
    read, written = F.sum("pagesIn"), F.sum("pagesOut")
    return t.table_use.agg(read.alias("r"), written.alias("w")).selectExpr("r * 100 div (r + w) AS read_pct", "w * 100 div (r + w) AS write_pct")


def _by_pid(*columns: str) -> Callable:
    def query(t: LogTables, q: Question) -> DataFrame:
        rows = t.joined.groupBy("pid").agg(F.min("user").alias("user"), *(F.max(c).alias(c) for c in columns))
        return rows.where(_over(columns, q.lock_ms)).orderBy("pid")

    return query


def x16(t, q):
    rows = t.process.where("cmd = 'user-submit' AND args = '-f //...'").groupBy(bucket("startTime", 10).alias("day"))
    return rows.agg(*_lapse("n", "mean", "most")).where(F.col("most") > q.slow_s).orderBy("day")


def x20(t, q):
    clock = F.date_format("startTime", "HH:mm:ss")
    return t.joined.where((F.col("tableName") == q.table) & clock.between(q.day_from, q.day_to)).select(*_LOCK).orderBy("startTime")


def x29(t, q):
    return t.process.where("endTime IS NULL").select("processkey", "startTime", "pid", "user", "cmd", "running")


def x30(t, q):
    at = F.lit(q.last)
    return t.process.where((F.col("startTime") < at) & (F.col("endTime") > at) | F.col("error") & _period(q)).select("processkey", "startTime", "endTime", "cmd", "error")


def x31(t, q):
    money = "decimal(9,2)"
    return t.process.groupBy("user").agg(F.count("*").alias("n"), F.avg("completedLapse").cast(money).cast("double").alias("mean_s"), F.sum("completedLapse").alias("total_s")).orderBy("user")


def x33(t, q):
    held = [F.sum(c).alias(c) for c in ("totalReadHeld", "totalWriteHeld")]
    rows = t.joined.where(_period(q) & _over(_READ_WRITE_HELD, q.lock_ms))
    return rows.groupBy("user").agg(F.count_distinct("lineNumber").alias("commands"), *held).orderBy("user")


def x34(t, q):
    integrations = t.process.where("cmd IN ('user-integ', 'user-integrate')")
    counts = integrations.agg(F.count("*").alias("all"), *(F.count_if(F.col("args").rlike(s)).alias(f"s{i}") for i, s in enumerate(INTEGRATION_SHAPES)))
    pairs = [F.struct(F.lit("*").alias("shape"), F.col("all").alias("n"))] + [F.struct(F.lit(s).alias("shape"), F.col(f"s{i}").alias("n")) for i, s in enumerate(INTEGRATION_SHAPES)]
    return counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.shape", "x.n")


def x36(t, q):
    seconds = lambda c: F.floor(F.max(c) / 1000).alias(f"{c}_s")
    lapse = F.max(F.unix_timestamp("endTime") - F.unix_timestamp("startTime")).alias("lapse_s")
    return t.joined.groupBy("pid").agg(seconds("totalReadHeld"), seconds("totalWriteHeld"), lapse).orderBy("pid")


def _by_app(where: str | None) -> Callable:
    def query(t: LogTables, q: Question) -> DataFrame:
        rows = t.process.where(where) if where else t.process
        return rows.groupBy("app").agg(F.count("*").alias("n"), F.avg("completedLapse").cast("decimal(9,2)").cast("double").alias("mean_s"), F.sum("completedLapse").alias("total_s")).orderBy(F.col("n").desc(), "app")

    return query


def x38_minutes(t, q):
    rows = t.process.where(F.col("cmd").isin("user-sync", "user-transmit")).groupBy(bucket("startTime", 16).alias("time"), "cmd")
    return rows.agg(*_lapse("n", "total", "mean"), F.sum("fileTotalsSndMB").alias("sent_mb"), F.sum("rpcSizeOut").alias("rpc_out_mb")).orderBy("time", "cmd")


def x39(t, q):
    gb = lambda c: F.round(F.sum(c) / 1024 / 1024 / 1024, 3)
    days = t.proxy.groupBy(bucket("endTime", 10).alias("day"))
    return days.agg(F.count("*").alias("n"), F.sum("proxyTotalsSvr").alias("svr_files"), F.sum("proxyTotalsCache").alias("cache_files"), gb("proxyTotalsSvrBytes").alias("svr_gb"), gb("proxyTotalsCacheBytes").alias("cache_gb")).orderBy("day")


EXAMPLES: dict[str, Callable[[LogTables, Question], DataFrame]] = {
    "x01_held": _locks(_READ_WRITE_HELD),
    "x02_waiting": _locks(_READ_WRITE_WAIT),
    "x03_running_per_second": _per(19, "running"),
    "x04_longest_computes": x04,
    "x05_most_io": lambda t, q: top(t.table_use.groupBy("processkey").agg(F.sum(F.col("pagesIn") + F.col("pagesOut")).alias("io")), 25, F.col("io").desc(), "processkey"),
    "x06_average_wait": lambda t, q: t.table_use.agg(F.round(F.avg(F.col("totalReadWait") + F.col("totalWriteWait")), 3).alias("mean_wait")),
    "x07_read_write_integers": x07,
    "x08_lock_offenders": lambda t, q: t.joined.groupBy("user").agg(F.sum(F.col("maxReadHeld") + F.col("maxWriteHeld")).alias("held_ms")).orderBy(F.col("held_ms").desc()),
    "x09_blocking": _locks(_READ_WRITE_HELD, "startTime", "endTime", "user", "cmd", "pid", "tableName", *_READ_WRITE_HELD),
    "x10_victims": _locks(_READ_WRITE_WAIT, "startTime", "endTime", "user", "cmd", "pid", "tableName", *_READ_WRITE_WAIT),
    "x11_blocked_and_blocking": _locks((*_READ_WRITE_HELD, *_READ_WRITE_WAIT)),
    "x12_busy_seconds": lambda t, q: t.process.groupBy(bucket("startTime", 19).alias("time")).agg(F.max("running").alias("running")).where(F.col("running") > q.busy).orderBy("time"),
    "x13_blocked_processes": _by_pid("totalReadWait", "totalWriteWait"),
    "x14_blocking_processes": _by_pid("totalReadHeld", "totalWriteHeld"),
    "x16_slow_days_of_a_command": x16,
    "x17_write_blockers": _locks(("totalWriteHeld",), "startTime", "cmd", "user", "tableName", "totalWriteHeld"),
    "x18_write_victims": _locks(("totalWriteWait",), "startTime", "cmd", "user", "tableName", "totalWriteWait"),
    "x19_writes": _locks(("totalWriteHeld", "totalWriteWait"), "startTime", "cmd", "user", "tableName", "totalWriteHeld", "totalWriteWait"),
    "x20_table_at_time_of_day": x20,
    "x21_count_in_period": lambda t, q: t.process.where(_period(q)).agg(F.count("*").alias("n")),
    "x22_finished_not_sync": lambda t, q: t.process.where("completedLapse > 0 AND cmd <> 'user-sync'").select("processkey", "cmd", "completedLapse"),
    "x23_slow_per_hour": _per(13, "n", "most", where=lambda q: F.col("completedLapse") > q.slow_s),
    "x24_mean_per_minute": _per(16, "mean"),
    "x25_incoming_per_minute": _per(16, "n"),
    "x25_incoming_per_hour": _per(13, "n"),
    "x26_incoming_of_user": _per(16, "n", where=lambda q: _period(q) & F.col("user").startswith(q.user), also=("user",)),
    "x27_sync_per_ten_minutes": _per(15, "n", "total", where=lambda q: F.col("cmd") == "user-sync"),
    "x28_locks_on_table": lambda t, q: t.joined.where(F.col("tableName") == q.table).select(*_LOCK),
    "x29_still_running": x29,
    "x30_at_a_moment": x30,
    "x31_by_user": x31,
    "x32_by_user_per_hour": _per(13, "n", "most", also=("user",)),
    "x33_held_in_period": x33,
    "x34_integration_shapes": x34,
    "x36_blockers_in_seconds": x36,
    "x37_by_application": _by_app(None),
    "x37_by_application_not_transfers": _by_app("cmd NOT IN ('user-sync', 'user-submit')"),
    "x38_by_command": lambda t, q: t.process.groupBy("cmd").agg(*_lapse("n", "total", "mean", "most"), F.sum("fileTotalsSndMB").alias("sent_mb")).orderBy("cmd"),
    "x38_transfers_per_minute": x38_minutes,
    "x39_proxy_daily": x39,
}

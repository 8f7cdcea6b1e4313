"""Cumulative metrics of commands and server events, as rows (metric, labels, value)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.scalars import client_of, program_label, replica_of
from timberline.plans import schemas as S


@dataclass
class MetricsConfig:
    """Labels and switches of the metrics. ``user_detail`` is a pattern for users with metrics by command."""

    server_id: str = ""
    sdp_instance: str = ""
    by_user: bool = True
    by_ip: bool = True
    user_detail: str = ""
    case_insensitive: bool = False
    version: str = "timberline"


#: Sums over all commands, by metric.
SUMS = {
    "p4_cmds_paused_cumulative": "paused", "p4_cmd_mem_mb": "memMB", "p4_cmd_mem_peak_mb": "memPeakMB",
    "p4_sync_files_added": "netSyncFilesAdded", "p4_sync_files_updated": "netSyncFilesUpdated", "p4_sync_files_deleted": "netSyncFilesDeleted",
    "p4_sync_bytes_added": "netSyncBytesAdded", "p4_sync_bytes_updated": "netSyncBytesUpdated",
} | {f"p4_lbr_{k.lower()}_{c.lower()}": f"lbr{k}{c}" for k in S.LBR_KINDS for c in S.LBR_COUNTERS}
#: Gauges that carry the last server event's value.
EVENT_GAUGES = {
    "p4_cmds_running_max": "activeThreadsMax", "p4_cmds_paused": "pausedThreads", "p4_cmds_paused_max": "pausedThreadsMax", "p4_cmds_paused_errors": "pausedErrorCount",
    "p4_pause_rate_cpu": "pauseRateCPU", "p4_pause_rate_mem": "pauseRateMem", "p4_pause_state_cpu": "cpuPressureState", "p4_pause_state_mem": "memPressureState",
}
TABLE_SECONDS = {"p4_total_read_wait_seconds": "totalReadWait", "p4_total_read_held_seconds": "totalReadHeld", "p4_total_write_wait_seconds": "totalWriteWait", "p4_total_write_held_seconds": "totalWriteHeld"}
GAUGES = {*EVENT_GAUGES, "p4_cmd_running", "p4_cmds_running", "p4_prom_cmds_pending"}


def _rows(df: DataFrame, values: dict[str, Column], labels: dict[str, Column]) -> DataFrame:
    """A row per metric and group; blank labels are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in labels.items())) if labels else None
    named = F.map_from_entries(F.filter(pairs, lambda p: (p["v"] != "") & p["v"].isNotNull())) if labels else F.expr("cast(map() as map<string,string>)")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()))).alias("x")
    return df.select(named.alias("labels"), each).select("x.metric", "labels", "x.value")


def snapshot(process: DataFrame, table_use: DataFrame, events: DataFrame, config: MetricsConfig | None = None, order: str = "lineNumber", lines: int | None = None, only: Callable[[str], bool] | None = None) -> DataFrame:
    """All metrics over the given commands and events; ``order`` says which of them is the last.

    ``only`` picks metrics by name; what the others need is not computed.
    """
    c = config or MetricsConfig()
    parts: list[DataFrame] = []

    def put(source: Callable[[], DataFrame], values: dict[str, Column], labels: dict[str, Column]) -> None:
        wanted = {m: v for m, v in values.items() if only is None or only(m)}
        if wanted:
            parts.append(_rows(source(), wanted, labels))

    def put_by(source: Callable[[], DataFrame], prefix: str, labels: dict[str, Column]) -> None:
        """Counter and seconds of the commands in each group."""
        groups = lambda: source().groupBy(*(v.alias(k) for k, v in labels.items())).agg(F.count("*").alias("_n"), F.sum("completedLapse").alias("_s"))
        put(groups, {f"{prefix}_counter": F.col("_n"), f"{prefix}_cumulative_seconds": F.col("_s")}, {k: F.col(k) for k in labels})

    zero = lambda x: F.coalesce(x, F.lit(0))
    totals = process.agg(F.count("*").alias("n"), F.max(F.struct(order, "running")).alias("last"), F.count_if(F.col("endTime").isNull()).alias("pending"), *(zero(F.sum(v)).alias(m) for m, v in SUMS.items()))
    server = events.agg(F.count("*").alias("events"), F.max(F.struct(order, "activeThreads", *EVENT_GAUGES.values())).alias("event"))
    newer = F.coalesce(F.col(f"event.{order}") > F.col(f"last.{order}"), F.col("event").isNotNull())
    running = zero(F.when(newer, F.col("event.activeThreads")).otherwise(F.col("last.running")))
    put(lambda: totals, {m: F.col(m) for m in SUMS}, {})
    put(lambda: totals, {"p4_prom_cmds_processed": F.col("n"), "p4_prom_cmds_pending": F.col("pending")}, {})
    put(lambda: server, {"p4_prom_svr_events_processed": F.col("events")} | {m: zero(F.col(f"event.{v}")) for m, v in EVENT_GAUGES.items()}, {})
    put(lambda: totals.crossJoin(server), {"p4_cmd_running": running, "p4_cmds_running": running}, {})  # one row each
    if lines is not None:
        put(lambda: server, {"p4_prom_log_lines_read": F.lit(lines)}, {})
    put(lambda: server, {"p4_prom_build_info": F.lit(1)}, {"version": F.lit(c.version)})

    cmd = {"cmd": F.col("cmd")}
    put_by(lambda: process, "p4_cmd", cmd)
    cpu = process.groupBy("cmd").agg(F.sum("uCpu").alias("u"), F.sum("sCpu").alias("s"), F.count_if("error").alias("e"))
    put(lambda: cpu, {"p4_cmd_cpu_user_cumulative_seconds": F.col("u") / 1000, "p4_cmd_cpu_system_cumulative_seconds": F.col("s") / 1000}, cmd)
    put(lambda: cpu.where("e > 0"), {"p4_cmd_error_counter": F.col("e")}, cmd)
    user = F.lower("user") if c.case_insensitive else F.col("user")
    if c.by_user:
        put_by(lambda: process, "p4_cmd_user", {"user": user})
    if c.user_detail:
        put_by(lambda: process.where(user.rlike(c.user_detail)), "p4_cmd_user_detail", {"user": user, **cmd})
    if c.by_ip:
        put_by(lambda: process, "p4_cmd_ip", {"ip": client_of(F.col("ip"))})
    put_by(lambda: process.where(replica_of(F.col("ip")) != ""), "p4_cmd_replica", {"replica": replica_of(F.col("ip"))})
    put_by(lambda: process, "p4_cmd_program", {"program": program_label(F.col("app"))})

    trigger = F.col("tableName").startswith("trigger_")
    tables = table_use.where(~trigger).groupBy("tableName").agg(*((F.sum(v) / 1000).alias(v) for v in TABLE_SECONDS.values()))
    put(lambda: tables, {m: F.col(v) for m, v in TABLE_SECONDS.items()}, {"table": F.col("tableName")})
    lapses = table_use.where(trigger).groupBy(F.substring("tableName", len("trigger_") + 1, 1000).alias("t")).agg(F.sum("triggerLapse").alias("s"))
    put(lambda: lapses, {"p4_total_trigger_lapse_seconds": F.col("s")}, {"trigger": F.col("t")})
    out = reduce(DataFrame.unionByName, parts)
    fixed = {k: v for k, v in (("serverid", c.server_id), ("sdpinst", c.sdp_instance)) if v}
    if fixed:
        pairs = F.create_map(*(F.lit(x) for kv in fixed.items() for x in kv))
        out = out.withColumn("labels", F.map_concat(pairs, "labels"))
    return out


def ticks(times: DataFrame, interval_s: int = 10, log: str = "log_id", time: str = "ts") -> DataFrame:
    """(log, tick): the first time of each log, then each first time at least the interval after the tick before.

    Each log's distinct seconds fold in order; they are bounded by the log's duration.
    """
    seconds = times.select(log, F.unix_timestamp(time).alias("s")).distinct().groupBy(log).agg(F.sort_array(F.collect_list("s")).alias("all"))
    step = lambda acc, s: F.when((F.size(acc) == 0) | (s >= F.element_at(acc, -1) + interval_s), F.concat(acc, F.array(s))).otherwise(acc)
    folded = F.aggregate("all", F.expr("cast(array() as array<bigint>)"), step)
    return seconds.select(log, F.explode(folded).alias("tick"))


def cumulative_at_ticks(counts: DataFrame, tick_rows: DataFrame, by: list[str], value: str, log: str = "log_id", second: str = "s") -> DataFrame:
    """(log, by..., tick, value): running totals of each series at every tick from its first on; ``counts`` has a row per series and second.

    A series' rows are folded to the tick that first sees them; ticks without any repeat the total.
    """
    w = Window.partitionBy(log).orderBy("tick")
    spans = tick_rows.withColumn("after", F.coalesce(F.lag("tick").over(w), F.lit(-(1 << 62))))
    placed = counts.join(spans, log).where((F.col(second) > F.col("after")) & (F.col(second) <= F.col("tick")))
    each = placed.groupBy(log, *by, "tick").agg(F.sum(value).alias(value))
    since = each.groupBy(log, *by).agg(F.min("tick").alias("_since"))
    grid = since.join(tick_rows, log).where(F.col("tick") >= F.col("_since")).select(log, *by, "tick", F.lit(0).cast("bigint").alias(value))
    each = each.unionByName(grid).groupBy(log, *by, "tick").agg(F.sum(value).alias(value))
    running = F.sum(value).over(Window.partitionBy(log, *by).orderBy("tick"))
    return each.withColumn(value, running)


def value_text(metric: Column, value: Column) -> Column:
    """Seconds with three decimals, all else as whole numbers."""
    return F.when(metric.endswith("_seconds") | (metric == "p4_cmds_paused_cumulative"), F.format_string("%.3f", value)).otherwise(F.format_string("%.0f", value))


def prometheus_lines(rows: DataFrame) -> DataFrame:
    """(metric, line): a sample per line, labels sorted by name, backslashes doubled."""
    pairs = F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"')))
    name = F.when(F.size("labels") > 0, F.concat("metric", F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.col("metric"))
    return rows.select("metric", F.concat(name, F.lit(" "), value_text(F.col("metric"), F.col("value"))).alias("line"))


def graphite_lines(rows: DataFrame, epoch: Column) -> DataFrame:
    """(metric, line) as ``name;label=value number epoch``."""
    pairs = F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(F.lit(";"), e["key"], F.lit("="), e["value"]))
    return rows.select("metric", F.concat("metric", F.array_join(pairs, ""), F.lit(" "), value_text(F.col("metric"), F.col("value")), F.lit(" "), epoch.cast("string")).alias("line"))

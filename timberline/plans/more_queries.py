"""Driver queries of the parser, functions, metrics, dashboards, locks, pending commands and proxy, with DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import scalars
from timberline.operators import records as R
from timberline.operators.framing import frame
from timberline.operators.correlate import Options
from timberline.operators.tables import build_tables, parse_log
from timberline.plans import binding, cases, dashboard, locks, metrics, proxy, rendered
from timberline.plans import schemas as S
from timberline.plans.binding import oracle
from timberline.plans.reports import bucket
from timberline.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOCK_MS = 1000


def _add(name: str, sql: str | None = None):
    def put(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


# Scalar functions


@_add("f04_parse_bytes", oracle("SELECT processkey, CASE lineNumber % 4 WHEN 0 THEN cast(memMB AS bigint) WHEN 1 THEN memMB * 1024 WHEN 2 THEN cast(memMB + 0.5 AS double) * 1048576 ELSE memMB * 1073741824 END :: bigint AS n FROM process", "process"))
def f04(spark, d):
    text = F.expr("concat(cast(memMB as string), CASE lineNumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN '.5M' ELSE 'G' END)")
    return binding.process(spark, d).select("processkey", scalars.byte_size(text).alias("n"))


@_add("f06_md5_key", f"WITH c AS ({rendered.DUCK_COMMANDS}) SELECT k, md5({rendered.DUCK_LINE}) AS processkey FROM c")
def f06(spark, d):
    return rendered.commands(spark, d).select("k", F.md5(F.expr(rendered._LINE)).alias("processkey"))


@_add("f07_time", oracle("SELECT processkey, startTime AS t FROM process", "process"))
def f07(spark, d):
    return binding.process(spark, d).select("processkey", scalars.parse_time(F.date_format("startTime", "yyyy/MM/dd HH:mm:ss")).alias("t"))


@_add("f08_time_lapse", oracle("SELECT processkey, startTime + to_seconds(cast(floor(completedLapse) AS bigint)) AS t FROM process", "process"))
def f08(spark, d):
    return binding.process(spark, d).select("processkey", scalars.plus_seconds(F.col("startTime"), F.col("completedLapse")).alias("t"))


@_add("f09_label_sanitise", r"SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_/+:@{}&%<>*\\.,()\[\]-]', '_', 'g') AS label FROM pages")
def f09(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", scalars.sanitise_label(F.col("url")).alias("label"))


_PROGRAM = r"regexp_replace(replace(app, ' (brokered)', ''), '[^a-zA-Z0-9_/+:@{}&%<>*\\.,()\[\]-]', '_', 'g')"
_REPLICA = "CASE WHEN strpos(ip, '/') > 1 THEN substr(ip, 1, strpos(ip, '/') - 1) ELSE '' END"
_CLIENT = "CASE WHEN strpos(ip, '/') > 1 THEN substr(ip, strpos(ip, '/') + 1) ELSE ip END"


@_add("f10_program", oracle(f"SELECT processkey, {_PROGRAM} AS program FROM process", "process"))
def f10(spark, d):
    return binding.process(spark, d).select("processkey", scalars.program_label(F.col("app")).alias("program"))


@_add("f11_ip_split", oracle(f"SELECT processkey, {_REPLICA} AS replica, {_CLIENT} AS client FROM process", "process"))
def f11(spark, d):
    return binding.process(spark, d).select("processkey", scalars.replica_of(F.col("ip")).alias("replica"), scalars.client_of(F.col("ip")).alias("client"))


@_add("f17_byte_count", oracle("SELECT lineNumber, CASE WHEN b >= 1000000000 THEN printf('%.1f GB', b / 1e9) WHEN b >= 1000000 THEN printf('%.1f MB', b / 1e6) WHEN b >= 1000 THEN printf('%.1f kB', b / 1e3) ELSE b || ' B' END AS size FROM (SELECT lineNumber, proxyTotalsSvr * 1250 * (lineNumber % 7) + 1 AS b FROM p4pcmd)", "p4pcmd"))
def f17(spark, d):
    return binding.proxy(spark, d).select("lineNumber", scalars.byte_count_decimal(F.expr("proxyTotalsSvr * 1250 * (lineNumber % 7) + 1")).alias("size"))


@_add("f18_buckets", oracle("SELECT processkey, " + ", ".join(f"substr(strftime(startTime, '%Y/%m/%d %H:%M:%S'), 1, {n}) AS b{n}" for n in (10, 13, 15, 16, 19)) + " FROM process", "process"))
def f18(spark, d):
    return binding.process(spark, d).select("processkey", *(bucket("startTime", n).alias(f"b{n}") for n in (10, 13, 15, 16, 19)))


@_add("f19_milliseconds", oracle("SELECT processkey, cast(floor(completedLapse * 1000) AS bigint) AS ms FROM process", "process"))
def f19(spark, d):
    return binding.process(spark, d).select("processkey", scalars.milliseconds(F.col("completedLapse")).alias("ms"))


_MS = "cast(floor(completedLapse * 1000) AS bigint)"


@_add("f20_humanise", oracle(f"SELECT processkey, CASE WHEN s = 0 THEN ms || 'ms' WHEN s >= 3600 THEN s // 3600 || 'h ' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' WHEN s >= 60 THEN s // 60 || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS lapse FROM (SELECT processkey, {_MS} AS ms, {_MS} // 1000 AS s FROM process)", "process"))
def f20(spark, d):
    return binding.process(spark, d).select("processkey", scalars.humanise(scalars.milliseconds(F.col("completedLapse"))).alias("lapse"))


# The parser over rendered logs

_C = f"WITH c AS ({rendered.DUCK_COMMANDS}) "


@_add("b05_blocks", _C + f"SELECT log_id, place * {rendered.LINES} + 3 * i + 1 AS line_no, 'info' AS btype, CASE WHEN i = 3 THEN 14 ELSE 1 END AS n FROM c, (SELECT unnest(range(4)) AS i)")
def b05(spark, d):
    return frame(rendered.lines(spark, d)).select("log_id", "line_no", "btype", F.size("lines").alias("n"))


def _decoded(spark: SparkSession, d: str, kind: str, fields: str, values: Callable[[tuple], list[tuple]]) -> DataFrame:
    """(log_id, line_no, fields...) of the parser's own records of a kind."""
    blocks = frame(rendered.lines(spark, d))

    def decode(batches):
        for batch in batches:
            found = [(b["log_id"], b["line_no"], *v) for b in batch.to_pylist() for r in R.recognise(b["btype"], b["line_no"], [x.decode() for x in b["lines"]]) if r[0] == kind for v in values(r)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=[f"c{i}" for i in range(len(found[0]))])

    columns = ["log_id string", "line_no bigint", *fields.split(", ")]
    out = blocks.mapInArrow(decode, ", ".join(f"c{i} {c.split()[1]}" for i, c in enumerate(columns)))
    return out.toDF(*(c.split()[0] for c in columns))


@_add("b06_block_types", oracle(f"SELECT * FROM (WITH c AS ({rendered.DUCK_COMMANDS}) SELECT 'info' AS btype, count(*) * 4 AS n FROM c UNION ALL SELECT 'error', count(*) FROM c WHERE k % 9 = 0 UNION ALL SELECT CASE lineNumber % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' ELSE 'pressure' END, count(*) FROM svr_events GROUP BY 1)", "svr_events"))
def b06(spark, d):
    errors = rendered.commands(spark, d).where("k % 9 = 0").selectExpr("concat('error', log_id) AS log_id", "k * 3 AS k").selectExpr("log_id", "posexplode(array('Perforce server error:', concat(char(9), 'Pid ', k), '')) AS (i, value)", "k").selectExpr("log_id", "k + i AS line_no", "value")
    lines = rendered.lines(spark, d).unionByName(errors).unionByName(rendered.event_lines(spark, d).selectExpr("concat('event', log_id) AS log_id", "line_no", "value"))
    return frame(lines).groupBy("btype").agg(F.count("*").alias("n"))


@_add("r01_start", _C + f"SELECT log_id, place * {rendered.LINES} + i AS line_no, k AS pid, 'user' || k % 50 AS user, cmd FROM c, (SELECT unnest([1, 10]) AS i)")
def r01(spark, d):
    return _decoded(spark, d, "start", "pid bigint, user string, cmd string", lambda r: [(r[1]["pid"], r[1]["user"], r[1]["cmd"])])


@_add("r05_completed", _C + f"SELECT log_id, place * {rendered.LINES} + 7 AS line_no, k AS pid, ended AS at, round(lapse_ms / 1000.0e0, 3) AS lapse FROM c")
def r05(spark, d):
    rows = _decoded(spark, d, "completed", "pid bigint, at string, lapse double", lambda r: [(r[2], r[3].strftime("%Y/%m/%d %H:%M:%S"), r[4])])
    return rows.withColumn("at", scalars.parse_time(F.col("at"))).withColumn("lapse", F.round("lapse", 3))


@_add("c01_process", _C + f"SELECT log_id, md5({rendered.DUCK_LINE}) AS processkey, place * {rendered.LINES} + 1 AS lineNumber, k AS pid, started AS startTime, ended AS endTime, round(compute_ms / 1000.0e0, 3) AS computedLapse, round(lapse_ms / 1000.0e0, 3) AS completedLapse, 'user' || k % 50 AS user, cmd, '//depot/' || k || '/...' AS args, k % 1000 AS uCpu, k % 9000 AS maxRss, 1 AS running, false AS error FROM c")
def c01(spark, d):
    rows = build_tables(parse_log(rendered.lines(spark, d))).process
    return rows.select("log_id", "processkey", "lineNumber", "pid", "startTime", "endTime", F.round("computedLapse", 3).alias("computedLapse"), F.round("completedLapse", 3).alias("completedLapse"), "user", "cmd", "args", "uCpu", "maxRss", F.col("running").cast("int").alias("running"), "error")


@_add("c02_table_use", _C + f"SELECT log_id, md5({rendered.DUCK_LINE}) AS processkey, place * {rendered.LINES} + 1 AS lineNumber, tbl AS tableName, k % 30 AS readLocks, k % 40 AS writeLocks, k % 500 AS totalReadWait, k % 600 AS totalReadHeld, k % 700 AS totalWriteWait, k % 800 AS totalWriteHeld FROM c")
def c02(spark, d):
    return build_tables(parse_log(rendered.lines(spark, d))).table_use.select("log_id", "processkey", "lineNumber", "tableName", "readLocks", "writeLocks", "totalReadWait", "totalReadHeld", "totalWriteWait", "totalWriteHeld")


_LBR = [f"lbr{k}{c}" for k in S.LBR_KINDS for c in ("Opens", "ReadBytes", "WriteBytes", "Copies")]


def _duck_lbr(column: str) -> str:
    kind = next(k for k in S.LBR_KINDS if column.startswith(f"lbr{k}") and column[3 + len(k)].isupper())
    value = {"Opens": "k % 41", "ReadBytes": "cast(floor((k % 46 + 0.5) * 1024) AS bigint)", "WriteBytes": "(k % 48) * 1048576", "Copies": "k % 54"}[column[3 + len(kind) :]]
    return f"CASE WHEN kind = '{kind}' THEN {value} ELSE 0 END AS {column}"


@_add("t10_command_tracking", _C + "SELECT k AS pid, k % 300 AS memMB, k % 400 AS memPeakMB, k % 21 AS rpcMsgsIn, k % 24 AS rpcSizeOut, k % 26 AS rpcHimarkRev, round((100 + k % 900) / 1000.0e0, 3) AS rpcSnd, cast(k % 27 AS double) AS rpcRcv, k % 31 AS fileTotalsSnd, k % 32 AS fileTotalsSndMB, k % 33 AS fileTotalsRcv, k % 34 AS fileTotalsRcvMB FROM c")
def t10(spark, d):
    rows = build_tables(parse_log(rendered.lines(spark, d))).process
    return rows.select("pid", "memMB", "memPeakMB", "rpcMsgsIn", "rpcSizeOut", "rpcHimarkRev", F.round("rpcSnd", 3).alias("rpcSnd"), "rpcRcv", "fileTotalsSnd", "fileTotalsSndMB", "fileTotalsRcv", "fileTotalsRcvMB")


@_add("t15_librarian", _C + f"SELECT k AS pid, {', '.join(map(_duck_lbr, _LBR))} FROM c")
def t15(spark, d):
    return build_tables(parse_log(rendered.lines(spark, d))).process.select("pid", *_LBR)


_LAST = "coalesce(last_value(CASE WHEN lineNumber % 3 = {0} THEN {1} END IGNORE NULLS) OVER (PARTITION BY lineNumber % 16 ORDER BY lineNumber), 0)"


@_add("e06_server_events", oracle("SELECT concat('log', lineNumber % 16) AS log_id, lineNumber * 2 + 1 AS lineNumber, eventTime, " + ", ".join(f"{_LAST.format(i, v)} AS {a}" for i, v, a in ((0, "lineNumber % 200", "activeThreads"), (1, "lineNumber % 30", "pausedThreads"), (2, "pauseRateCPU", "pauseRateCPU"), (2, "memPressureState", "memPressureState"))) + " FROM svr_events", "svr_events"))
def e06(spark, d):
    rows = build_tables(parse_log(rendered.event_lines(spark, d))).events
    return rows.select("log_id", "lineNumber", "eventTime", "activeThreads", "pausedThreads", "pauseRateCPU", "memPressureState")


# The parser over small logs, one for each order


def _case_process(name: str, of: list[cases.Case]) -> None:
    seconds = ("computedLapse", "completedLapse", "paused")

    def query(spark, d):
        rows = build_tables(parse_log(cases.lines_of(spark, d, of))).process
        return rows.select(*(F.round(c, 3).alias(c) if c in seconds else F.col(c) for c in cases.PROCESS_COLUMNS))

    _add(name, cases.process_twin(of))(query)


def _case_order(name: str, of: list[cases.Case], options: Options | None = None) -> None:
    def query(spark, d):
        out = parse_log(cases.lines_of(spark, d, of), options).where(F.col("command").isNotNull())
        return out.select("log_id", "emitted", "command.lineNumber", "command.processkey", "command.endTime")

    _add(name, cases.order_twin(of))(query)


_case_process("d01_decisions", cases.DECISIONS)
_case_process("r02_start_forms", cases.STARTS)
_case_process("c04_updates", cases.UPDATES)
_case_order("w00_flush_order", cases.FLUSHES)
_case_order("w09_no_completion_records", cases.NO_COMPLETION, Options(no_completion_records=True))
_case_order("w10_durations", cases.SLOW, Options(output_every=timedelta(seconds=10)))


@_add("t05_table_sections", cases.others_twin(cases.SECTIONS))
def t05(spark, d):
    rows = build_tables(parse_log(cases.lines_of(spark, d, cases.SECTIONS))).table_use
    return rows.select("log_id", "processkey", "lineNumber", "tableName", *(F.round(c, 3).alias(c) if c == "triggerLapse" else F.col(c) for c in cases.TABLE_DEFAULTS))


@_add("e07_event_maxima", cases.others_twin(cases.EVENTS))
def e07(spark, d):
    return build_tables(parse_log(cases.lines_of(spark, d, cases.EVENTS))).events.select("log_id", *cases.EVENT_COLUMNS)


# Metrics


def _flat(rows: DataFrame) -> DataFrame:
    pairs = F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("metric", F.array_join(pairs, ",").alias("labels"), F.round("value", 3).alias("value"))


def _snapshot(spark: SparkSession, d: str, only: Callable[[str], bool]) -> DataFrame:
    config = metrics.MetricsConfig(user_detail="User1.*", case_insensitive=False)
    return metrics.snapshot(binding.process(spark, d), binding.table_use(spark, d), binding.events(spark, d), config, only=only)


def _metric(*prefixes: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _flat(_snapshot(spark, d, lambda m: m.startswith(prefixes)))


def _grouped(prefix: str, label: str, by: str, where: str = "true") -> str:
    base = f"SELECT {by} AS g, count(*) AS n, sum(completedLapse) AS s FROM process WHERE {where} GROUP BY 1"
    return oracle(f"SELECT '{prefix}_counter' AS metric, '{label}=' || g AS labels, cast(n AS double) AS value FROM ({base}) UNION ALL SELECT '{prefix}_cumulative_seconds', '{label}=' || g, round(s, 3) FROM ({base})", "process")


_add("m65_cmd_counter", oracle("SELECT 'p4_cmd_counter' AS metric, 'cmd=' || cmd AS labels, cast(count(*) AS double) AS value FROM process GROUP BY cmd", "process"))(_metric("p4_cmd_counter"))
_add("m66_cmd_seconds", oracle("SELECT 'p4_cmd_cumulative_seconds' AS metric, 'cmd=' || cmd AS labels, round(sum(completedLapse), 3) AS value FROM process GROUP BY cmd", "process"))(_metric("p4_cmd_cumulative_seconds"))
_add("m67_cmd_cpu", oracle("SELECT 'p4_cmd_cpu_user_cumulative_seconds' AS metric, 'cmd=' || cmd AS labels, round(sum(uCpu) / 1000.0e0, 3) AS value FROM process GROUP BY cmd UNION ALL SELECT 'p4_cmd_cpu_system_cumulative_seconds', 'cmd=' || cmd, round(sum(sCpu) / 1000.0e0, 3) FROM process GROUP BY cmd", "process"))(_metric("p4_cmd_cpu_"))
_add("m69_cmd_errors", oracle("SELECT 'p4_cmd_error_counter' AS metric, 'cmd=' || cmd AS labels, cast(count(*) AS double) AS value FROM process WHERE error GROUP BY cmd", "process"))(_metric("p4_cmd_error_counter"))
_add("m70_user", _grouped("p4_cmd_user", "user", "user"))(_metric("p4_cmd_user_counter", "p4_cmd_user_cumulative"))
_add("m71_ip", _grouped("p4_cmd_ip", "ip", _CLIENT))(_metric("p4_cmd_ip_"))
_add("m72_user_detail", _grouped("p4_cmd_user_detail", "cmd", "cmd || ',user=' || user", "regexp_matches(user, 'User1.*')"))(_metric("p4_cmd_user_detail_"))
_add("m73_replica", _grouped("p4_cmd_replica", "replica", _REPLICA, f"{_REPLICA} <> ''"))(_metric("p4_cmd_replica_"))
_add("m74_program", _grouped("p4_cmd_program", "program", _PROGRAM))(_metric("p4_cmd_program_"))
_add("m75_table_locks", oracle(" UNION ALL ".join(f"SELECT '{m}' AS metric, 'table=' || tableName AS labels, round(sum({c}) / 1000.0e0, 3) AS value FROM tableUse WHERE NOT starts_with(tableName, 'trigger_') GROUP BY tableName" for m, c in metrics.TABLE_SECONDS.items()), "tableUse"))(_metric("p4_total_read", "p4_total_write"))
_add("m76_trigger_lapse", oracle("SELECT 'p4_total_trigger_lapse_seconds' AS metric, 'trigger=' || substr(tableName, 9) AS labels, round(sum(triggerLapse), 3) AS value FROM tableUse WHERE starts_with(tableName, 'trigger_') GROUP BY tableName", "tableUse"))(_metric("p4_total_trigger"))
_add("m13_totals", oracle(" UNION ALL ".join(f"SELECT '{m}' AS metric, '' AS labels, cast(round(sum({c}), 3) AS double) AS value FROM process" for m, c in metrics.SUMS.items() if not m.startswith("p4_lbr")), "process"))(_metric(*(m for m in metrics.SUMS if not m.startswith("p4_lbr"))))
_add("m17_lbr_totals", oracle(" UNION ALL ".join(f"SELECT '{m}' AS metric, '' AS labels, cast(sum({c}) AS double) AS value FROM process" for m, c in metrics.SUMS.items() if m.startswith("p4_lbr")), "process"))(_metric("p4_lbr_"))
_EVENT = " UNION ALL ".join(f"SELECT '{m}' AS metric, '' AS labels, cast(max_by({c}, lineNumber) AS double) AS value FROM svr_events" for m, c in metrics.EVENT_GAUGES.items())
_add("m10_event_gauges", oracle(_EVENT, "svr_events"))(lambda spark, d: _flat(_snapshot(spark, d, metrics.EVENT_GAUGES.__contains__)))
_RUNNING = "(SELECT CASE WHEN (SELECT max(lineNumber) FROM svr_events) > (SELECT max(lineNumber) FROM process) THEN (SELECT max_by(activeThreads, lineNumber) FROM svr_events) ELSE (SELECT max_by(running, lineNumber) FROM process) END)"
_add("m07_counts", oracle(f"SELECT 'p4_prom_cmds_processed' AS metric, '' AS labels, cast(count(*) AS double) AS value FROM process UNION ALL SELECT 'p4_prom_svr_events_processed', '', count(*) FROM svr_events UNION ALL SELECT 'p4_prom_cmds_pending', '', count(*) FROM process WHERE endTime IS NULL UNION ALL SELECT unnest(['p4_cmd_running', 'p4_cmds_running']), '', {_RUNNING}", "process", "svr_events"))(
    lambda spark, d: _flat(_snapshot(spark, d, {"p4_prom_cmds_processed", "p4_prom_svr_events_processed", "p4_prom_cmds_pending", "p4_cmd_running", "p4_cmds_running"}.__contains__))
)


_TICKS = """SELECT * FROM (WITH RECURSIVE secs AS (SELECT DISTINCT epoch(startTime)::bigint AS s FROM process), t AS (
  SELECT min(s) AS tick FROM secs UNION ALL SELECT (SELECT min(s) FROM secs WHERE s >= t.tick + 864000) FROM t WHERE t.tick IS NOT NULL
), spans AS (SELECT tick, coalesce(lag(tick) OVER (ORDER BY tick), -1) AS after FROM t WHERE tick IS NOT NULL),
e AS (SELECT cmd, tick, count(*) AS c FROM process JOIN spans ON epoch(startTime)::bigint > after AND epoch(startTime)::bigint <= tick GROUP BY ALL)
SELECT 'log' AS log_id, cmd, tick, cast((SELECT sum(c) FROM e WHERE e.cmd = s.cmd AND e.tick <= spans.tick) AS bigint) AS n
FROM spans JOIN (SELECT cmd, min(tick) AS since FROM e GROUP BY cmd) s ON spans.tick >= since)"""


@_add("m02_historical_ticks", oracle(_TICKS, "process"))
def m02(spark, d):
    """Counter of each command at ten-day ticks."""
    rows = binding.process(spark, d).select(F.lit("log").alias("log_id"), F.col("startTime").alias("ts"), "cmd")
    at = metrics.ticks(rows, 864_000)
    counts = rows.groupBy("log_id", "cmd", F.unix_timestamp("ts").alias("s")).agg(F.count("*").alias("n"))
    return metrics.cumulative_at_ticks(counts, at, ["cmd"], "n")


@_add("k04_prometheus_text", oracle("SELECT 'p4_cmd_counter{cmd=\"' || cmd || '\"} ' || count(*) AS line FROM process GROUP BY cmd", "process"))
def k04(spark, d):
    return metrics.prometheus_lines(_snapshot(spark, d, "p4_cmd_counter".__eq__)).select("line")


# Dashboards, over counters by day


def _series(spark: SparkSession, d: str, value: str = "n") -> DataFrame:
    days = binding.process(spark, d).groupBy("cmd", F.date_trunc("day", "startTime").alias("day")).agg(F.count("*").alias("n"), F.sum("completedLapse").alias("s"))
    from pyspark.sql import Window

    return days.select("cmd", F.unix_timestamp("day").alias("ts"), F.sum(value).over(Window.partitionBy("cmd").orderBy("day")).alias("value"))


def _duck_series(value: str = "count(*)") -> str:
    return f"SELECT cmd, epoch(day)::bigint AS ts, sum(v) OVER (PARTITION BY cmd ORDER BY day) AS value FROM (SELECT cmd, date_trunc('day', startTime) AS day, {value} AS v FROM process GROUP BY ALL)"


_DAYS = 10 * 86_400
_RATE = f"SELECT *, sum(d) OVER (PARTITION BY cmd ORDER BY ts RANGE BETWEEN {_DAYS - 1} PRECEDING AND CURRENT ROW) / {_DAYS} AS rate FROM (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY cmd ORDER BY ts), 0) AS d FROM (SERIES))"


@_add("g01_rate", oracle(f"SELECT ts, round(cast(sum(rate) AS double), 9) AS rate FROM ({_RATE.replace('SERIES', _duck_series())}) GROUP BY ts", "process"))
def g01(spark, d):
    return dashboard.total(dashboard.rate(_series(spark, d), ["cmd"], _DAYS), "rate").withColumn("rate", F.round("rate", 9))


@_add("g02_gauge", oracle("SELECT epoch(eventTime)::bigint AS ts, activeThreads AS value FROM svr_events WHERE activeThreads > 0", "svr_events"))
def g02(spark, d):
    return binding.events(spark, d).where("activeThreads > 0").select(F.unix_timestamp("eventTime").alias("ts"), F.col("activeThreads").alias("value"))


@_add("g04_topk", oracle(f"SELECT cmd, ts, cast(value AS bigint) AS value FROM ({_duck_series()}) QUALIFY row_number() OVER (PARTITION BY ts ORDER BY value DESC, cmd) <= 3", "process"))
def g04(spark, d):
    return dashboard.top_k(_series(spark, d), 3, "value", "cmd")


@_add("g05_topk_rate", oracle(f"SELECT cmd, ts, round(cast(rate AS double), 9) AS rate FROM ({_RATE.replace('SERIES', _duck_series())}) QUALIFY row_number() OVER (PARTITION BY ts ORDER BY rate DESC, cmd) <= 3", "process"))
def g05(spark, d):
    rows = dashboard.top_k(dashboard.rate(_series(spark, d), ["cmd"], _DAYS), 3, "rate", "cmd")
    return rows.select("cmd", "ts", F.round("rate", 9).alias("rate"))


@_add("g07_ratio", oracle(f"SELECT a.cmd, a.ts, round(a.value / b.value, 6) AS value FROM ({_duck_series('sum(completedLapse)')}) a JOIN ({_duck_series()}) b ON a.cmd = b.cmd AND a.ts = b.ts", "process"))
def g07(spark, d):
    out = dashboard.ratio(_series(spark, d, "s"), _series(spark, d), ["cmd"])
    return out.withColumn("value", F.round("value", 6))


# Locks, pending, proxy

_SIDES = " UNION ALL ".join(f"SELECT 'db.' || tableName AS \"table\", pid, cmd, p.lineNumber AS line, user, startTime AS start, endTime, '{s.lower()}' AS side, total{s}Wait AS wait, total{s}Held AS held, greatest(total{s}Wait, total{s}Held) AS max_lock FROM tableUse u JOIN process p ON u.processkey = p.processkey WHERE (total{s}Wait > {LOCK_MS} OR total{s}Held > {LOCK_MS}) AND NOT regexp_matches(tableName, '(clients|changes)')" for s in ("Read", "Write"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return locks.lock_records(binding.process(spark, d), binding.table_use(spark, d), LOCK_MS, "clients|changes")


@_add("l03_lock_records", oracle(_SIDES, "process", "tableUse"))
def l03(spark, d):
    return _records(spark, d).select("table", "pid", "cmd", "line", "user", "start", "endTime", "side", "wait", "held", "max_lock")


_ORDER = ", ".join(f"('{n}', {i})" for i, n in enumerate(locks.LOCK_ORDER))


@_add("l05_lock_order", oracle(f"SELECT l.\"table\", place, count(*) AS n, cast(sum(max_lock) AS bigint) AS ms FROM ({_SIDES}) l JOIN (VALUES {_ORDER}) o(t, place) ON l.\"table\" = o.t GROUP BY ALL", "process", "tableUse"))
def l05(spark, d):
    return locks.in_lock_order(_records(spark, d), LOCK_MS).groupBy("table", "place").agg(F.count("*").alias("n"), F.sum("max_lock").alias("ms"))


@_add("l06_intervals", oracle(f"WITH r AS ({_SIDES}), i AS (SELECT \"table\", pid, line, cmd, user, side, 'wait' AS what, epoch_ms(start) AS from_ms, epoch_ms(start) + wait AS to_ms FROM r UNION ALL SELECT \"table\", pid, line, cmd, user, side, 'held', epoch_ms(start) + wait, epoch_ms(start) + wait + held FROM r) SELECT * FROM i WHERE to_ms > from_ms", "process", "tableUse").replace(" WITH r AS", ", r AS", 1))
def l06(spark, d):
    return locks.intervals(_records(spark, d))


@_add("p01_pending", oracle("SELECT processkey, lineNumber, startTime, pid, user, cmd, args FROM process WHERE endTime IS NULL", "process"))
def p01(spark, d):
    return locks.pending(binding.process(spark, d)).select("processkey", "lineNumber", "startTime", "pid", "user", "cmd", "args")


@_add("p02_pending_counts", oracle("SELECT 'total' AS what, (SELECT count(*) FROM process) + (SELECT count(*) FROM svr_events) AS n UNION ALL SELECT 'pending', (SELECT count(*) FROM process WHERE endTime IS NULL)", "process", "svr_events"))
def p02(spark, d):
    return locks.pending_counts(binding.process(spark, d), binding.events(spark, d))


@_add("l07_lock_counts", oracle(f"SELECT 'commands' AS what, (SELECT count(*) FROM process) AS n UNION ALL SELECT 'records', (SELECT count(*) FROM ({_SIDES}))", "process", "tableUse"))
def l07(spark, d):
    return locks.lock_counts(binding.process(spark, d), _records(spark, d))


@_add("k06_lock_pages", oracle(f"SELECT cast(count(*) AS bigint) AS records, cast(sum(length(\"table\" || ' ' || side)) AS bigint) AS label_chars, cast(sum(wait) AS bigint) AS wait, cast(sum(held) AS bigint) AS held, min(start) AS first FROM ({_SIDES})", "process", "tableUse"))
def k06(spark, d):
    """What the data arrays of all lock pages hold, read back from the pages."""
    pages = sinks.lock_pages(_records(spark, d), 1000)
    data = F.from_json(F.regexp_extract("html", "(?s)const rows=(\\[.*?\\]);\n", 1), "array<struct<label string, wait bigint, held bigint, start string>>")
    rows = pages.select(F.explode(data).alias("r")).select("r.*")
    return rows.agg(F.count("*").alias("records"), F.sum(F.length("label")).alias("label_chars"), F.sum("wait").alias("wait"), F.sum("held").alias("held"), scalars.parse_time(F.min("start")).alias("first"))


def proxy_lines(spark: SparkSession, d: str) -> DataFrame:
    """The bound proxy rows as proxy-log text of one log; every fifth block lacks tracking."""
    text = [
        "'Perforce proxy info:'", "concat(char(9), date_format(endTime, 'yyyy/MM/dd HH:mm:ss'), ' pid ', pid, ' completed ', lineNumber % 5000, '.5s')",
        "CASE WHEN lineNumber % 5 = 0 THEN 'no tracking' ELSE concat('--- proxytotals files/size svr+cache ', proxyTotalsSvr, '+', proxyTotalsCache, '/', lineNumber, 'M+', lineNumber, 'K') END", "''",
    ]
    rows = binding.proxy(spark, d).select("lineNumber", F.posexplode(F.array(*(F.expr(t) for t in text))).alias("i", "value"))
    return rows.select(F.lit("proxy").alias("log_id"), (F.col("lineNumber") * 4 + F.col("i") + 1).alias("line_no"), "value")


@_add("y04_proxy_totals", oracle("SELECT lineNumber * 4 + 1 AS lineNumber, pid, endTime, lineNumber % 5000 + 0.5e0 AS completedLapse, proxyTotalsSvr, proxyTotalsCache, lineNumber * 1048576 AS proxyTotalsSvrBytes, lineNumber * 1024 AS proxyTotalsCacheBytes FROM p4pcmd WHERE lineNumber % 5 <> 0", "p4pcmd"))
def y04(spark, d):
    return proxy.parse_proxy(proxy_lines(spark, d)).drop("log_id")


_INSERT = f"INSERT INTO p4pcmd ({','.join(S.PROXY_COLUMNS)}) VALUES ("


@_add("y06_proxy_sql", oracle(f"SELECT '{_INSERT}' || concat_ws(',', lineNumber * 4 + 1, pid, '''' || strftime(endTime, '%Y/%m/%d %H:%M:%S') || '''', printf('%.3f', lineNumber % 5000 + 0.5e0), proxyTotalsSvr, proxyTotalsCache, lineNumber * 1048576, lineNumber * 1024) || ');' AS value FROM p4pcmd WHERE lineNumber % 5 <> 0", "p4pcmd"))
def y06(spark, d):
    return sinks.sql_inserts(proxy.parse_proxy(proxy_lines(spark, d)), "p4pcmd", S.PROXY_COLUMNS)

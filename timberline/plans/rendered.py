"""The bound orders written as server-log text, to run the parser at scale against a plain select.

Each order is a command with its four blocks, one after the other; orders of a log follow by start and key. A log
is a residue of the customer, so there are many of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOGS = 64
#: Lines of a command.
LINES = 24

_START = "date_format(started, 'yyyy/MM/dd HH:mm:ss')"
_LINE = f"concat(char(9), {_START}, ' pid ', k, ' user', k % 50, '@ws', k % 20, ' 10.0.0.', k % 200, ' [p4/v', k % 5, \"] '\", cmd, ' //depot/', k, \"/...'\")"
_MS = "concat({0} div 1000, '.', lpad(cast({0} % 1000 as string), 3, '0'))"
_TEMPLATE = [
    "'Perforce server info:'", _LINE, "''",
    "'Perforce server info:'", f"concat(char(9), {_START}, ' pid ', k, ' compute end ', {_MS.format('compute_ms')}, 's')", "''",
    "'Perforce server info:'", f"concat(char(9), date_format(ended, 'yyyy/MM/dd HH:mm:ss'), ' pid ', k, ' completed ', {_MS.format('lapse_ms')}, 's')", "''",
    "'Perforce server info:'", _LINE, f"concat('--- lapse ', {_MS.format('lapse_ms')}, 's')",
    "concat('--- usage ', k % 1000, '+', k % 700, 'us 12+13io 14+15net ', k % 9000, 'k 22pf')",
    "concat('--- memory cmd/proc ', k % 300, 'mb/', k % 400, 'mb')",
    "concat('--- rpc msgs/size in+out ', k % 21, '+', k % 22, '/', k % 23, 'mb+', k % 24, 'mb himarks ', k % 25, '/', k % 26, ' snd/rcv .', 100 + k % 900, 's/', k % 27, 's')",
    "concat('--- filetotals (svr) send/recv files+bytes ', k % 31, '+', k % 32, 'mb/', k % 33, '+', k % 34, 'mb')",
    "concat('--- lbr ', kind)", "concat('---   opens+closes+checkins+exists ', k % 41, '+', k % 42, '+', k % 43, '+', k % 44)",
    "concat('---   reads+readbytes+writes+writebytes ', k % 45, '+', k % 46, '.5K+', k % 47, '+', k % 48, 'M')",
    "concat('---   digests+filesizes+modtimes+copies ', k % 51, '+', k % 52, '+', k % 53, '+', k % 54)", "concat('--- unknown/', k)",
    "concat('--- db.', tbl)", "concat('---   locks read/write ', k % 30, '/', k % 40, ' rows get+pos+scan put+del 1+2+3 4+5')",
    "concat('---   total lock wait+held read/write ', k % 500, 'ms+', k % 600, 'ms/', k % 700, 'ms+-', k % 800, 'ms')",
]

_CMD = "CASE k % 4 WHEN 0 THEN 'user-sync' WHEN 1 THEN 'user-submit' WHEN 2 THEN 'user-fstat' ELSE 'dm-CommitSubmit' END"
_TBL = "CASE k % 3 WHEN 0 THEN 'have' WHEN 1 THEN 'rev' ELSE 'integed' END"

_KIND = "CASE k % 4 WHEN 0 THEN 'Rcs' WHEN 1 THEN 'Binary' WHEN 2 THEN 'Compress' ELSE 'Uncompress' END"


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_custkey", "timestampadd(SECOND, cast((o_orderkey * 37) % 86400 as int), o_orderdate) AS started")
    rows = rows.selectExpr("k", "concat('log', o_custkey % 64) AS log_id", "started", "(k * 7919) % 600000 + 1 AS lapse_ms", "(k * 31) % 5000 + 1 AS compute_ms", f"{_CMD} AS cmd", f"{_TBL} AS tbl", f"{_KIND} AS kind")
    rows = rows.withColumn("ended", F.expr("timestampadd(SECOND, cast(lapse_ms div 1000 as int), started)"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("log_id").orderBy("started", "k")).cast("bigint") - 1)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, line_no, value)"""
    rows = commands(spark, sf_dir).select("log_id", "place", F.posexplode(F.array(*(F.expr(t) for t in _TEMPLATE))).alias("i", "value"))
    return rows.select("log_id", (F.col("place") * LINES + F.col("i") + 1).alias("line_no"), "value")


#: DuckDB's form of ``commands``.
DUCK_COMMANDS = f"""SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY started, k) - 1 AS place, started + to_seconds(cast(lapse_ms // 1000 AS bigint)) AS ended FROM (
  SELECT k, concat('log', o_custkey % 64) AS log_id, started, (k * 7919) % 600000 + 1 AS lapse_ms, (k * 31) % 5000 + 1 AS compute_ms, {_CMD} AS cmd, {_TBL} AS tbl, {_KIND} AS kind FROM (
    SELECT o_orderkey AS k, o_custkey, o_orderdate + to_seconds(cast((o_orderkey * 37) % 86400 AS bigint)) AS started FROM orders))"""
DUCK_LINE = "chr(9) || strftime(started, '%Y/%m/%d %H:%M:%S') || ' pid ' || k || ' user' || k % 50 || '@ws' || k % 20 || ' 10.0.0.' || k % 200 || ' [p4/v' || k % 5 || '] ''' || cmd || ' //depot/' || k || '/...'''"


#: Server events as one-line blocks: the kind follows from the event's number.
_EVENT_LINE = """concat(date_format(eventTime, 'yyyy/MM/dd HH:mm:ss'), ' 111222333 pid ', lineNumber % 1000, ': ', CASE lineNumber % 3
  WHEN 0 THEN concat('Server is now using ', lineNumber % 200, ' active threads.')
  WHEN 1 THEN concat('Server now has ', lineNumber % 30, ' paused threads.')
  ELSE concat('Server under resource pressure.  Pause rate CPU ', pauseRateCPU, '%, mem ', pauseRateMem, '%, CPU pressure ', cpuPressureState, ', mem pressure ', memPressureState) END)"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, line_no, value) of the bound server events, in 16 logs, with a blank line after each."""
    from timberline.plans.binding import events

    rows = events(spark, sf_dir).selectExpr("concat('log', lineNumber % 16) AS log_id", "lineNumber * 2 + 1 AS line_no", f"explode(array(struct(0 AS i, {_EVENT_LINE} AS v), struct(1 AS i, '' AS v))) AS x")
    return rows.selectExpr("log_id", "line_no + x.i AS line_no", "x.v AS value")

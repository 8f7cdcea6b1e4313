"""The driver's tables seen as a parsed log, so that reports run at any scale factor.

Every column is integer arithmetic on keys, written so that Spark and DuckDB read it alike; only adding seconds
to a time differs. ``duckdb_views`` gives the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.plans import schemas as S

_K = "o_orderkey"

_PROCESS: dict[str, str] = {
    "processkey": f"md5(concat('o', cast({_K} as string)))",
    "lineNumber": f"{_K} * 10 + 1",
    "pid": "o_custkey",
    "startTime": f"@add(o_orderdate, ({_K} * 37) % 86400)",
    "endTime": f"CASE WHEN {_K} % 97 = 0 THEN NULL ELSE @add(o_orderdate, ({_K} * 37) % 86400 + ({_K} * 7919) % 600000 // 1024) END",
    "computedLapse": f"cast(({_K} * 31) % 5000 as double) / 1024",
    "completedLapse": f"cast(({_K} * 7919) % 600000 as double) / 1024",
    "paused": f"cast({_K} % 7 as double) / 8",
    "user": "concat('User', cast(o_custkey % 50 as string))",
    "workspace": "concat('ws', cast(o_custkey % 20 as string))",
    "ip": f"CASE WHEN {_K} % 3 = 0 THEN concat('10.0.0.', cast({_K} % 4 as string), '/192.168.1.', cast({_K} % 20 as string)) ELSE concat('192.168.1.', cast({_K} % 20 as string)) END",
    "app": f"CASE WHEN {_K} % 5 = 0 THEN concat(o_orderpriority, ' (brokered)') ELSE concat('app=', o_orderpriority) END",
    "cmd": f"CASE {_K} % 7 WHEN 0 THEN 'user-sync' WHEN 1 THEN 'user-submit' WHEN 2 THEN 'user-transmit' WHEN 3 THEN 'user-integrate' WHEN 4 THEN 'rmt-Journal' WHEN 5 THEN 'user-fstat' ELSE 'pull' END",
    "args": f"CASE {_K} % 6 WHEN 0 THEN '-b branch -r' WHEN 1 THEN '-S //stream -n' WHEN 2 THEN '-Rb //depot/a //depot/b' WHEN 3 THEN '-f //...' WHEN 4 THEN '-c 123' ELSE '' END",
    "rpcSnd": f"cast(({_K} * 3) % 900 as double) / 8",
    "rpcRcv": f"cast(({_K} * 5) % 700 as double) / 8",
    "running": f"({_K} * 31) % 60",
    "error": f"{_K} % 37 = 0",
}
for _i, _name in enumerate(S.COUNTERS):
    _PROCESS[_name] = f"({_K} * {_i + 3}) % {1000 + 37 * _i}"

_TABLE_NAMES = ("have", "rev", "integed", "trigger_swarm", "meta_db", "clients_a", "storageup_R", "changes_b", "counters", "monitor", "user", "working")
_TABLE = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_TABLE_NAMES)) + " END"
_USE = {"processkey": "md5(concat('o', cast(l_orderkey as string)))", "lineNumber": "l_orderkey * 10 + 1", "tableName": _TABLE}
_USE_COUNTERS = {n: f"max((l_orderkey * {i + 7} + l_suppkey * {i + 1} + l_linenumber) % {500 + 211 * i})" for i, n in enumerate(S.TABLE_COUNTERS)}
_USE_COUNTERS["triggerLapse"] = f"max(CASE WHEN {_TABLE} LIKE 'trigger%' THEN cast((l_orderkey * 13) % 4000 as double) / 1024 ELSE 0.0e0 END)"

_EVENTS = {
    "lineNumber": "event_id",
    "eventTime": "date_trunc('second', ts)",
    "activeThreads": "CASE WHEN event_type = 'error' THEN event_id % 200 ELSE 0 END",
    "activeThreadsMax": "CASE WHEN event_type = 'error' THEN event_id % 200 + 5 ELSE 0 END",
    "pausedThreads": "CASE WHEN event_type = 'click' THEN event_id % 30 ELSE 0 END",
    "pausedThreadsMax": "CASE WHEN event_type = 'click' THEN event_id % 30 + 2 ELSE 0 END",
    "pausedErrorCount": "event_id % 3",
    "pauseRateCPU": "user_id % 100",
    "pauseRateMem": "user_id % 90",
    "cpuPressureState": "user_id % 3",
    "memPressureState": "event_id % 4",
}
_PROXY = {
    "lineNumber": "event_id",
    "pid": "user_id",
    "endTime": "date_trunc('second', ts)",
    "completedLapse": "cast(event_id % 5000 as double) / 1024",
    "proxyTotalsSvr": "event_id % 50",
    "proxyTotalsCache": "event_id % 70",
    "proxyTotalsSvrBytes": "event_id * 1048576",
    "proxyTotalsCacheBytes": "event_id * 524288",
}


def _spark(text: str) -> str:
    return _times(text, spark=True)


def _times(text: str, spark: bool) -> str:
    """``@add(time, seconds)`` in the engine's own words."""
    head, *calls = text.split("@add(")
    out = head
    for call in calls:
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(call[end], 0)
            end += 1
        time, seconds = call[: end - 1].split(", ", 1)
        out += f"timestampadd(SECOND, cast({seconds} as int), {time})" if spark else f"({time} + to_seconds(cast({seconds} as bigint)))"
        out += call[end:]
    return out.replace(" // ", " div ") if spark else out


def process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{_spark(_PROCESS[c])} AS {c}" for c in S.PROCESS_COLUMNS))


def table_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several items of an order may name one table; their counters' maxima make one row."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    from pyspark.sql import functions as F

    return items.groupBy(*(F.expr(_USE[c]).alias(c) for c in _USE)).agg(*(F.expr(v).alias(c) for c, v in _USE_COUNTERS.items()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('error', 'click', 'view')")
    return rows.selectExpr(*(f"{v} AS {c}" for c, v in _EVENTS.items()))


def proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('purchase', 'signup')")
    return rows.selectExpr(*(f"{v} AS {c}" for c, v in _PROXY.items()))


def duckdb_views() -> dict[str, str]:
    """The tables as DuckDB selects, by name. ``svr_events`` are the server's events."""
    columns = lambda exprs: ", ".join(f"{_times(v, spark=False) if '@add' in v else v} AS {c}" for c, v in exprs.items())
    ordered = {c: _PROCESS[c] for c in S.PROCESS_COLUMNS}
    return {
        "process": f"SELECT {columns(ordered)} FROM orders",
        "tableUse": f"SELECT {columns(_USE)}, {columns(_USE_COUNTERS)} FROM lineitem GROUP BY 1, 2, 3",
        "svr_events": f"SELECT {columns(_EVENTS)} FROM events WHERE event_type IN ('error', 'click', 'view')",
        "p4pcmd": f"SELECT {columns(_PROXY)} FROM events WHERE event_type IN ('purchase', 'signup')",
    }


def oracle(query: str, *tables: str) -> str:
    """A DuckDB query over the named tables."""
    views = duckdb_views()
    return "WITH " + ", ".join(f"{t} AS ({views[t]})" for t in tables) + " " + query

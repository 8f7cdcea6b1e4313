"""DuckDB twins of the example queries, over the bound tables."""

from __future__ import annotations

from timberline.plans.binding import oracle
from timberline.plans.examples import INTEGRATION_SHAPES, Question

_JOIN = "tableUse u JOIN process p ON u.processkey = p.processkey"
_LOCK = "startTime, endTime, computedLapse, running, cmd, pid, tableName, maxReadHeld, maxWriteHeld, totalReadWait, totalWriteWait"
_LAPSE = {"n": "count(*) AS n", "total": "sum(completedLapse) AS total", "mean": "round(avg(completedLapse), 3) AS mean", "most": "max(completedLapse) AS most"}


def _bucket(time: str, chars: int) -> str:
    return f"substr(strftime({time}, '%Y/%m/%d %H:%M:%S'), 1, {chars})"


def example_oracles(q: Question) -> dict[str, str]:
    p, u, both = ("process",), ("tableUse",), ("process", "tableUse")
    period = f"startTime BETWEEN TIMESTAMP '{q.first}' AND TIMESTAMP '{q.last}'"

    def over(*columns: str) -> str:
        return "(" + " OR ".join(f"{c} > {q.lock_ms}" for c in columns) + ")"

    def locks(columns: tuple[str, ...], shown: str = _LOCK) -> str:
        return oracle(f"SELECT {shown} FROM {_JOIN} WHERE {over(*columns)}", *both)

    def per(chars: int, *aggs: str, where: str = "true", also: str = "") -> str:
        return oracle(f"SELECT {_bucket('startTime', chars)} AS time{also and ', ' + also}, {', '.join(aggs)} FROM process WHERE {where} GROUP BY ALL", *p)

    def by_pid(*columns: str) -> str:
        return oracle(f"SELECT pid, min(user) AS user, {', '.join(f'max({c}) AS {c}' for c in columns)} FROM {_JOIN} GROUP BY pid HAVING {' OR '.join(f'max({c}) > {q.lock_ms}' for c in columns)}", *both)

    def by_app(where: str) -> str:
        return oracle(f"SELECT app, count(*) AS n, cast(cast(avg(completedLapse) AS decimal(9,2)) AS double) AS mean_s, sum(completedLapse) AS total_s FROM process WHERE {where} GROUP BY app", *p)

    held, wait = ("totalReadHeld", "totalWriteHeld"), ("totalReadWait", "totalWriteWait")
    n, total, mean, most = (_LAPSE[k] for k in ("n", "total", "mean", "most"))
    running = "max(running) AS running"
    sums = lambda c, a: f"cast(sum({c}) AS bigint) AS {a}"
    shapes = " UNION ALL ".join(["SELECT '*' AS shape, count(*) AS n FROM i", *(f"SELECT '{s}', count(*) FROM i WHERE regexp_matches(args, '{s}')" for s in INTEGRATION_SHAPES)])
    gb = lambda c, a: f"round(cast(sum({c}) AS double) / 1024 / 1024 / 1024, 3) AS {a}"
    return {
        "x01_held": locks(held),
        "x02_waiting": locks(wait),
        "x03_running_per_second": per(19, running),
        "x04_longest_computes": oracle("SELECT processkey, max(totalReadHeld + totalWriteHeld) - max(totalReadWait + totalWriteWait) AS compute_ms FROM tableUse GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", *u),
        "x05_most_io": oracle("SELECT processkey, cast(sum(pagesIn + pagesOut) AS bigint) AS io FROM tableUse GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", *u),
        "x06_average_wait": oracle("SELECT round(avg(totalReadWait + totalWriteWait), 3) AS mean_wait FROM tableUse", *u),
        "x07_read_write_integers": oracle("SELECT cast(sum(pagesIn) * 100 // (sum(pagesIn) + sum(pagesOut)) AS bigint) AS read_pct, cast(sum(pagesOut) * 100 // (sum(pagesIn) + sum(pagesOut)) AS bigint) AS write_pct FROM tableUse", *u),
        "x08_lock_offenders": oracle(f"SELECT user, {sums('maxReadHeld + maxWriteHeld', 'held_ms')} FROM {_JOIN} GROUP BY 1", *both),
        "x09_blocking": locks(held, f"startTime, endTime, user, cmd, pid, tableName, {', '.join(held)}"),
        "x10_victims": locks(wait, f"startTime, endTime, user, cmd, pid, tableName, {', '.join(wait)}"),
        "x11_blocked_and_blocking": locks((*held, *wait)),
        "x12_busy_seconds": oracle(f"SELECT {_bucket('startTime', 19)} AS time, {running} FROM process GROUP BY 1 HAVING max(running) > {q.busy}", *p),
        "x13_blocked_processes": by_pid(*wait),
        "x14_blocking_processes": by_pid(*held),
        "x16_slow_days_of_a_command": oracle(f"SELECT {_bucket('startTime', 10)} AS day, {n}, {mean}, {most} FROM process WHERE cmd = 'user-submit' AND args = '-f //...' GROUP BY 1 HAVING max(completedLapse) > {q.slow_s}", *p),
        "x17_write_blockers": locks(("totalWriteHeld",), "startTime, cmd, user, tableName, totalWriteHeld"),
        "x18_write_victims": locks(("totalWriteWait",), "startTime, cmd, user, tableName, totalWriteWait"),
        "x19_writes": locks(("totalWriteHeld", "totalWriteWait"), "startTime, cmd, user, tableName, totalWriteHeld, totalWriteWait"),
        "x20_table_at_time_of_day": oracle(f"SELECT {_LOCK} FROM {_JOIN} WHERE tableName = '{q.table}' AND strftime(startTime, '%H:%M:%S') BETWEEN '{q.day_from}' AND '{q.day_to}'", *both),
        "x21_count_in_period": oracle(f"SELECT {n} FROM process WHERE {period}", *p),
        "x22_finished_not_sync": oracle("SELECT processkey, cmd, completedLapse FROM process WHERE completedLapse > 0 AND cmd <> 'user-sync'", *p),
        "x23_slow_per_hour": per(13, n, most, where=f"completedLapse > {q.slow_s}"),
        "x24_mean_per_minute": per(16, mean),
        "x25_incoming_per_minute": per(16, n),
        "x25_incoming_per_hour": per(13, n),
        "x26_incoming_of_user": per(16, n, where=f"{period} AND user LIKE '{q.user}%'", also="user"),
        "x27_sync_per_ten_minutes": per(15, n, total, where="cmd = 'user-sync'"),
        "x28_locks_on_table": oracle(f"SELECT {_LOCK} FROM {_JOIN} WHERE tableName = '{q.table}'", *both),
        "x29_still_running": oracle("SELECT processkey, startTime, pid, user, cmd, running FROM process WHERE endTime IS NULL", *p),
        "x30_at_a_moment": oracle(f"SELECT processkey, startTime, endTime, cmd, error FROM process WHERE startTime < TIMESTAMP '{q.last}' AND endTime > TIMESTAMP '{q.last}' OR error AND {period}", *p),
        "x31_by_user": oracle("SELECT user, count(*) AS n, cast(cast(avg(completedLapse) AS decimal(9,2)) AS double) AS mean_s, sum(completedLapse) AS total_s FROM process GROUP BY user", *p),
        "x32_by_user_per_hour": per(13, n, most, also="user"),
        "x33_held_in_period": oracle(f"SELECT user, count(DISTINCT p.lineNumber) AS commands, {sums('totalReadHeld', 'totalReadHeld')}, {sums('totalWriteHeld', 'totalWriteHeld')} FROM {_JOIN} WHERE {period} AND {over(*held)} GROUP BY user", *both),
        "x34_integration_shapes": oracle(f"SELECT * FROM (WITH i AS (SELECT args FROM process WHERE cmd IN ('user-integ', 'user-integrate')) {shapes})", *p),
        "x36_blockers_in_seconds": oracle(f"SELECT pid, max(totalReadHeld) // 1000 AS totalReadHeld_s, max(totalWriteHeld) // 1000 AS totalWriteHeld_s, max(date_diff('second', startTime, endTime)) AS lapse_s FROM {_JOIN} GROUP BY pid", *both),
        "x37_by_application": by_app("true"),
        "x37_by_application_not_transfers": by_app("cmd NOT IN ('user-sync', 'user-submit')"),
        "x38_by_command": oracle(f"SELECT cmd, {n}, {total}, {mean}, {most}, {sums('fileTotalsSndMB', 'sent_mb')} FROM process GROUP BY cmd", *p),
        "x38_transfers_per_minute": oracle(f"SELECT {_bucket('startTime', 16)} AS time, cmd, {n}, {total}, {mean}, {sums('fileTotalsSndMB', 'sent_mb')}, {sums('rpcSizeOut', 'rpc_out_mb')} FROM process WHERE cmd IN ('user-sync', 'user-transmit') GROUP BY ALL", *p),
        "x39_proxy_daily": oracle(f"SELECT {_bucket('endTime', 10)} AS day, {n}, {sums('proxyTotalsSvr', 'svr_files')}, {sums('proxyTotalsCache', 'cache_files')}, {gb('proxyTotalsSvrBytes', 'svr_gb')}, {gb('proxyTotalsCacheBytes', 'cache_gb')} FROM p4pcmd GROUP BY 1", "p4pcmd"),
    }

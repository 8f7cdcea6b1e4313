"""DuckDB twins of the report queries, over the bound tables, with the thresholds of the driver's queries."""

from __future__ import annotations

from timberline.plans.binding import oracle

_MIN = "strftime(startTime, '%Y/%m/%d %H:%M')"
_TEN = "substr(strftime(startTime, '%Y/%m/%d %H:%M'), 1, 15)"
_JOIN = "tableUse u JOIN process p ON u.processkey = p.processkey"
_LONG = "startTime, endTime, pid, user, round(completedLapse) AS lapse_s, running, cmd, args, lineNumber FROM process"
_CPU = "pid, user, cmd, round(completedLapse, 3) AS lapse, round(rpcRcv, 3) AS rpc_receive_wait_s, round(rpcSnd, 3) AS rpc_send_wait_s, uCpu AS u_cpu_ms, sCpu AS s_cpu_ms, startTime, endTime FROM process"
_HELD = "startTime, endTime, pid, user, round(completedLapse) AS lapse_s, running, tableName, totalReadHeld, totalWriteHeld, cmd, args"
_WHO = "(SELECT processkey, min(user) AS user, min(cmd) AS cmd, min(startTime) AS startTime, min(args) AS args FROM process GROUP BY 1)"


def report_oracles(lock_ms: int) -> dict[str, str]:
    p, u, both = ("process",), ("tableUse",), ("process", "tableUse")
    counted = "count(cmd) AS num_cmds FROM process GROUP BY ALL ORDER BY num_cmds DESC"
    return {
        "q01_timerange": oracle("SELECT min(startTime) AS start_time, max(startTime) AS end_time FROM process", *p),
        "q02_command_counts": oracle(f"SELECT cmd, {counted}, cmd LIMIT 25", *p),
        "q03_commands_by_user": oracle(f"SELECT cmd, user, {counted}, cmd, user LIMIT 30", *p),
        "q04_commands_by_app": oracle(f"SELECT cmd, app, {counted}, cmd, app LIMIT 30", *p),
        "q05_long_commands": oracle(f"SELECT {_LONG} WHERE completedLapse > 100 AND cmd NOT IN ('user-sync', 'user-transmit')", *p),
        "q06_long_sync_commands": oracle(f"SELECT {_LONG} WHERE completedLapse > 500 AND cmd IN ('user-sync', 'user-transmit')", *p),
        "q07_busy_periods": oracle(f"SELECT {_MIN} AS minute, max(running) AS running FROM process GROUP BY 1 HAVING max(running) > 20 ORDER BY 1 LIMIT 25", *p),
        "q08_memory_usage": oracle("SELECT pid, user, cmd, app, round(completedLapse, 2) AS lapse_s, round(rpcRcv) AS rpc_receive_wait_s, round(rpcSnd) AS rpc_send_wait_s, memMB, memPeakMB, uCpu, sCpu, startTime, endTime FROM process ORDER BY maxRss DESC, lineNumber LIMIT 25", *p),
        "q09_cpu_system": oracle(f"SELECT {_CPU} ORDER BY sCpu DESC, lineNumber LIMIT 25", *p),
        "q10_cpu_user": oracle(f"SELECT {_CPU} ORDER BY uCpu DESC, lineNumber LIMIT 25", *p),
        "q11_cpu_consumers": oracle("SELECT DISTINCT pid, user, cmd, round(completedLapse, 2) AS lapse_s, uCpu AS u_cpu_ms, startTime, endTime, args FROM process WHERE cmd NOT IN ('user-sync', 'user-transmit') ORDER BY u_cpu_ms DESC, pid, startTime, lapse_s LIMIT 25", *p),
        "q12_io_usage": oracle(f"SELECT w.user, w.cmd, io_pages, w.processkey, w.args FROM (SELECT processkey, cast(sum(pagesIn + pagesOut) AS bigint) AS io_pages FROM tableUse GROUP BY 1) x JOIN {_WHO} w ON x.processkey = w.processkey ORDER BY io_pages DESC, w.processkey LIMIT 25", *both),
        "q13_read_write_pct": oracle("SELECT round(sum(pagesIn) * 100.0e0 / (sum(pagesIn) + sum(pagesOut)), 3) AS read_pct, round(sum(pagesOut) * 100.0e0 / (sum(pagesIn) + sum(pagesOut)), 3) AS write_pct FROM tableUse", *u),
        "q14_triggers": oracle(f"SELECT tableName AS trigger, cmd, count(*) AS num_triggers, round(avg(triggerLapse), 2) AS avg_lapse, round(max(triggerLapse), 2) AS max_lapse FROM {_JOIN} WHERE tableName ILIKE 'trigger_%' GROUP BY 1, 2", *both),
        "q15_locks_contention_summary": oracle(f"SELECT * FROM (SELECT tableName, count(readLocks) AS num_read_locks, round(avg(readLocks)) AS avg_read_locks, round(avg(writeLocks)) AS avg_write_locks, round(avg(totalReadWait)) AS avg_read_wait, round(avg(totalReadHeld)) AS avg_read_held, round(avg(totalWriteWait)) AS avg_write_wait, round(avg(totalWriteHeld)) AS avg_write_held, cast(sum(totalReadWait + totalWriteWait) AS bigint) AS total_wait, cast(sum(totalReadHeld + totalWriteHeld) AS bigint) AS total_held FROM tableUse GROUP BY 1) WHERE total_wait > {lock_ms} AND total_held > {lock_ms}", *u),
        "q16_blocking_commands": oracle(f"SELECT startTime, endTime, running, user, cmd, pid, tableName, maxReadHeld, totalReadHeld, maxWriteHeld, totalWriteHeld, totalReadWait, totalWriteWait FROM {_JOIN} WHERE (totalReadHeld > {lock_ms} OR totalWriteHeld > {lock_ms}) AND tableName NOT ILIKE 'meta%' AND tableName NOT ILIKE 'clients%' AND tableName NOT ILIKE 'changes%' ORDER BY startTime, endTime NULLS FIRST, p.lineNumber, tableName LIMIT 30", *both),
        "q17_blocking_read_commands": oracle(f"SELECT {_HELD} FROM {_JOIN} WHERE completedLapse > 100 ORDER BY totalReadHeld DESC, p.lineNumber, tableName LIMIT 30", *both),
        "q18_blocking_write_commands": oracle(f"SELECT {_HELD} FROM {_JOIN} WHERE completedLapse > 100 ORDER BY totalWriteHeld DESC, p.lineNumber, tableName LIMIT 30", *both),
        "q19_blocked_commands": oracle(f"SELECT startTime, endTime, round(computedLapse, 2) AS computed_lapse_s, running, user, cmd, pid, tableName, maxReadHeld, maxWriteHeld, totalReadWait, totalWriteWait FROM {_JOIN} WHERE totalReadWait > {lock_ms} OR totalWriteWait > {lock_ms} ORDER BY startTime, endTime NULLS FIRST, p.lineNumber, tableName LIMIT 30", *both),
        "q20_worst_offenders": oracle(f"SELECT user, cast(sum(maxReadHeld + maxWriteHeld) AS bigint) AS held_ms FROM {_JOIN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", *both),
        "q21_avg_wait": oracle("SELECT round(avg(totalReadWait + totalWriteWait), 2) AS wait FROM tableUse", *u),
        "q22_longest_phases": oracle(f"SELECT x.processkey, w.user, w.cmd, w.startTime, CASE WHEN h > n THEN h - n ELSE h END AS compute_ms, w.args FROM (SELECT processkey, max(totalReadHeld + totalWriteHeld) AS h, max(totalReadWait + totalWriteWait) AS n FROM tableUse GROUP BY 1) x JOIN {_WHO} w ON x.processkey = w.processkey ORDER BY compute_ms DESC, x.processkey LIMIT 25", *both),
        "q23_replication_times": oracle(f"SELECT {_TEN} AS ten_minutes, user, count(cmd) AS n, min(cmd) AS cmd, round(max(completedLapse), 2) AS max_time, round(sum(completedLapse), 2) AS total_time, round(avg(completedLapse), 2) AS average_time FROM process WHERE cmd = 'rmt-Journal' GROUP BY 1, 2", *p),
    }

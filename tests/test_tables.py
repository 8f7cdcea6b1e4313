"""Sinks, metrics, proxy logs, dashboards, streaming, and the driver's contract."""

import json
import os
from datetime import datetime

import pytest

TEXT = """
Perforce server info:
\t2021/03/04 05:06:07 pid 4242 mona@ws 10.1.1.1/127.0.0.1 [app (brokered)] 'user-sync //...'
Perforce server info:
\t2021/03/04 05:06:07 pid 4242 completed .047s
Perforce server info:
\t2021/03/04 05:06:07 pid 4242 mona@ws 10.1.1.1/127.0.0.1 [app (brokered)] 'user-sync //...'
--- db.have
---   total lock wait+held read/write 12000ms+22000ms/24000ms+500000ms
---   max lock wait+held read/write 32ms+33ms/34ms+35ms

Perforce server info:
\t2021/03/04 05:06:18 pid 17 o'neil@ws 10.1.1.2 [x\\y] 'user-fstat //a'

2021/03/04 05:06:29 111222333 pid 9090: Server is now using 55 active threads.
"""


@pytest.fixture(scope="module")
def tables(spark):
    from timberline.operators.tables import build_tables, parse_log
    from timberline.sources.logs import lines_of_text

    parsed = parse_log(lines_of_text(spark, TEXT)).cache()
    return build_tables(parsed), parsed


def test_parquet_report_and_sql(spark, tables, tmp_path):
    from timberline.plans.reports import Thresholds
    from timberline.sources import sinks

    built, parsed = tables
    sinks.write_tables(built, f"file://{tmp_path}/t")
    log = sinks.read_tables(spark, f"file://{tmp_path}/t")
    for form in ("text", "csv", "html", "json"):
        assert "have" in sinks.render_report(log, form, Thresholds(), ("basic", "locks"))
    with pytest.raises(ValueError):
        sinks.render_report(log, "text", None, ("users",))
    sinks.write_sql(built, f"file://{tmp_path}/sql")
    inserts = [r["value"] for r in spark.read.text(f"file://{tmp_path}/sql/process").collect()]
    assert len(inserts) == 2 and any("'o''neil'" in x for x in inserts)
    import sqlite3

    db = sqlite3.connect(":memory:")
    for part in ("schema", "process", "tableUse", "events"):
        for r in spark.read.text(f"file://{tmp_path}/sql/{part}").collect():
            db.execute(r["value"])
    assert db.execute("SELECT totalWriteHeld FROM tableUse JOIN process USING (processkey)").fetchall() == [(500000,)]
    sinks.write_json(parsed, f"file://{tmp_path}/json")
    rows = [json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/json").collect()]
    assert {r.get("cmd") for r in rows} == {"user-sync", "user-fstat", None}
    assert next(r for r in rows if r.get("cmd") == "user-sync")["tables"][0]["tableName"] == "have"


def test_locks_and_pending(tables):
    from timberline.plans import locks
    from timberline.sources.sinks import lock_page, pending_json

    built, _ = tables
    records = locks.lock_records(built.process, built.table_use)
    assert {(r["table"], r["side"], r["max_lock"]) for r in records.collect()} == {("db.have", "read", 22000), ("db.have", "write", 500000)}
    assert locks.lock_records(built.process, built.table_use, 500_000).count() == 0  # strictly above
    assert locks.lock_records(built.process, built.table_use, 10_000, "ha").count() == 0
    assert [r["what"] for r in locks.intervals(records).orderBy("side", "from_ms").collect()] == ["wait", "held", "wait", "held"]
    assert "db.have write" in lock_page(records)
    pending = locks.pending(built.process)
    assert [r["cmd"] for r in pending.collect()] == ["user-fstat"] and pending_json(pending).count() == 1


def test_metrics(tables):
    from timberline.plans import metrics
    from pyspark.sql import functions as F

    built, _ = tables
    rows = metrics.snapshot(built.process, built.table_use, built.events, metrics.MetricsConfig(server_id="s1", user_detail=".*"), lines=19)
    lines = {r["line"] for r in metrics.prometheus_lines(rows).collect()}
    assert 'p4_cmd_counter{cmd="user-sync",serverid="s1"} 1' in lines
    assert 'p4_cmd_program_counter{program="x\\\\y",serverid="s1"} 1' in lines
    assert 'p4_cmd_program_cumulative_seconds{program="app",serverid="s1"} 0.047' in lines
    assert 'p4_cmd_replica_counter{replica="10.1.1.1",serverid="s1"} 1' in lines and 'p4_cmd_ip_counter{ip="127.0.0.1",serverid="s1"} 1' in lines
    assert 'p4_total_write_held_seconds{serverid="s1",table="have"} 500.000' in lines
    assert 'p4_cmds_running{serverid="s1"} 55' in lines and 'p4_prom_log_lines_read{serverid="s1"} 19' in lines
    assert any(line.startswith("p4_cmd_counter;cmd=user-sync;serverid=s1 1 1614834367") for line in (r["line"] for r in metrics.graphite_lines(rows, F.lit(1614834367)).collect()))


def test_ticks_are_greedy(spark):
    from timberline.plans import metrics

    base = datetime(2020, 1, 1)
    times = spark.createDataFrame([("l", base.replace(second=s)) for s in (0, 4, 9, 11, 12, 20, 21, 40)], "log_id string, ts timestamp")
    got = sorted(r["tick"] % 60 for r in metrics.ticks(times, 10).collect())
    assert got == [0, 11, 21, 40]


def test_counter_restart_in_rate(spark):
    from timberline.plans.dashboard import rate

    df = spark.createDataFrame([("a", 0, 5), ("a", 10, 8), ("a", 20, 2)], "k string, ts bigint, value bigint")
    assert [r["rate"] * 60 for r in rate(df, ["k"], 60).orderBy("ts").collect()] == [0.0, 3.0, 5.0]


def test_proxy(spark):
    from timberline.plans.proxy import parse_proxy
    from timberline.sources.logs import lines_of_text

    text = "\nPerforce proxy info:\n\t2020/10/11 12:13:14 pid 31337 completed .19s 5+6us\n--- lapse .2s\n--- proxytotals files/size svr+cache 1+2/100B+2.5K\n\nPerforce proxy info:\n\t2020/10/11 12:13:15 pid 2 completed .1s\n"
    (row,) = parse_proxy(lines_of_text(spark, text)).collect()
    assert (row["lineNumber"], row["pid"], row["proxyTotalsSvrBytes"], row["proxyTotalsCacheBytes"], round(row["completedLapse"], 3)) == (2, 31337, 100, 2560, 0.2)


def test_streaming_equals_batch(spark, tables, tmp_path):
    from timberline.streaming.live import live_commands

    lines = TEXT.split("\n")
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        part = [{"log_id": "log", "line_no": i + 1, "value": v} for i, v in enumerate(lines) if i * 3 // len(lines) == k]
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(source / f"{k}.json", (1_600_000_000 + k, 1_600_000_000 + k))  # files are taken by age
    stream = spark.readStream.schema("log_id string, line_no bigint, value string").option("maxFilesPerTrigger", 1).json(f"file://{source}")
    query = live_commands(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("live").collect()
    assert [r["kind"] for r in rows].count("event") <= 1
    commands = [json.loads(r["row"]) for r in rows if r["kind"] == "command"]
    built, _ = tables
    keys = {r["processkey"] for r in built.process.collect()}
    assert {c["processkey"] for c in commands} <= keys and "user-sync" in {c["cmd"] for c in commands}


def test_first_row_wins(spark):
    from timberline.operators.tables import first_rows

    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("b", 1, 3)], "k string, n int, emitted int")
    assert sorted((r["k"], r["emitted"]) for r in first_rows(df, ["k", "n"]).collect()) == [("a", 1), ("b", 3)]


def test_file_names():
    from timberline.sources.sinks import file_name

    assert file_name("", ".db", ["a/server.log.gz"]) == "a/server.db"
    assert file_name("x", ".json", []) == "x.json" and file_name("x.json", ".json", []) == "x.json"


def test_entry_points(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert entry.entry(spark).count() >= 0

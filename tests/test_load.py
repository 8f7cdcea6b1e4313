"""The loader command, lock pages, counters and the longest line."""

import json
import re
import sqlite3

import pytest

from tests.test_tables import TEXT


def rows_of(page):
    return json.loads(re.search(r"(?s)const rows=(\[.*?\]);\n", page)[1])


def test_loader_writes_all_kinds(spark, tmp_path):
    from timberline.load import main

    (tmp_path / "a.log").write_text(TEXT)
    out = f"{tmp_path}/out"
    main([f"file://{tmp_path}/a.log", "--out", f"file://{out}", "--to", "tables", "sql", "json", "metrics", "locks", "pending"])
    assert spark.read.parquet(f"file://{out}/tables/process").count() == 2
    assert spark.read.text(f"file://{out}/sql/process").count() == 2 and spark.read.text(f"file://{out}/json").count() == 3
    assert any(r["value"].startswith('p4_cmd_counter{cmd="user-sync"} 1') for r in spark.read.text(f"file://{out}/metrics").collect())
    (page,) = [r["value"] for r in spark.read.text(f"file://{out}/locks", wholetext=True).collect()]
    assert [(r["label"], r["wait"], r["held"]) for r in rows_of(page)] == [("db.have read", 12000, 22000), ("db.have write", 24000, 500000)]
    assert {tuple(r) for r in spark.read.option("header", True).csv(f"file://{out}/pending_counts").collect()} == {("total", "3"), ("pending", "1")}
    assert {tuple(r) for r in spark.read.option("header", True).csv(f"file://{out}/lock_counts").collect()} == {("commands", "2"), ("records", "2")}


def test_proxy_loader(spark, tmp_path):
    from timberline.load import main

    (tmp_path / "p.log").write_text("\nPerforce proxy info:\n\t2020/10/11 12:13:14 pid 31337 completed .19s 5+6us\n--- lapse .2s\n--- proxytotals files/size svr+cache 1+2/100B+2.5K\n\n")
    out = f"{tmp_path}/out"
    main([f"file://{tmp_path}/p.log", "--out", f"file://{out}", "--proxy", "--to", "tables", "sql", "json"])
    db = sqlite3.connect(":memory:")
    for part in ("schema", "p4pcmd"):
        for r in spark.read.text(f"file://{out}/sql/{part}").collect():
            db.execute(r["value"])
    assert db.execute("SELECT pid, endTime, completedLapse, proxyTotalsCacheBytes FROM p4pcmd").fetchall() == [(31337, "2020/10/11 12:13:14", 0.2, 2560)]
    assert spark.read.parquet(f"file://{out}/tables/p4pcmd").count() == 1
    assert json.loads(spark.read.text(f"file://{out}/json/p4pcmd").first()["value"])["endTime"] == "2020/10/11 12:13:14"
    with pytest.raises(SystemExit):
        main(["x", "--out", "y", "--proxy", "--to", "locks"])


def test_lock_pages_hold_every_record(spark):
    from timberline.sources.sinks import lock_page, lock_pages

    rows = spark.range(250).selectExpr("concat('db.', id % 3) AS table", "'read' AS side", "id AS line", "id AS pid", "'</script><b>' AS cmd", "'u' AS user", "timestamp_seconds(id % 40) AS start", "id * 10 AS wait", "id AS held", "id * 10 AS max_lock")
    assert lock_pages(rows, 20).count() == 13 and lock_pages(rows.where("false"), 20).count() == 0
    pages = lock_pages(rows, 1).collect()  # several parts
    assert len(pages) == 250
    pages = lock_pages(rows, 20).collect()
    found = [r for p in sorted(pages, key=lambda p: p["page"]) for r in rows_of(p["html"])]
    assert sorted(r["line"] for r in found) == list(range(250)) and [r["at"] for r in found] == sorted(r["at"] for r in found)
    assert max(p["rows"] for p in pages) <= 20 and sum(p["rows"] for p in pages) == 250
    assert all("</script><b>" not in p["html"] for p in pages) and found[0]["cmd"] == "</script><b>"
    assert len(rows_of(lock_page(rows, 250))) == 250 and rows_of(lock_page(rows.where("false"))) == []
    with pytest.raises(ValueError):
        lock_page(rows, 249)


def test_longest_line(spark, tmp_path, monkeypatch):
    from timberline.sources import logs

    monkeypatch.setattr(logs, "LONGEST_LINE", 100)
    (tmp_path / "l").write_text("x" * 100 + "\nshort\n")
    assert logs.read_lines(spark, [f"file://{tmp_path}/l"], max_line=50).count() == 2
    (tmp_path / "m").write_text("x" * 101 + "\nshort\n")
    with pytest.raises(Exception, match="over 100 bytes: 101"):
        logs.read_lines(spark, [f"file://{tmp_path}/m"], max_line=50).collect()

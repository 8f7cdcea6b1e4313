"""Golden tests of the log parser, on the plain fold; the Spark path is compared with it at the end."""

import hashlib
from datetime import datetime

import pytest

from timberline.operators import records as R
from timberline.operators.correlate import Correlator


def blocks_of(text):
    """Plain block framing, line by line."""
    out, block = [], None
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r\n")
        ignored = line.startswith(R.IGNORED_PREFIXES)
        if R.is_block_end(line):
            out.append(block)
            block = None
        if ignored:
            continue
        if block is None:
            block = [n, "blank", []]
        if block[1] == "blank":
            block[1] = R.block_type(line)
            if block[1] in ("active", "paused", "pressure"):
                block[2].append(line)
        else:
            block[2].append(line)
    out.append(block)
    return [b for b in out if b and b[2]]


def parse(text):
    state, out = Correlator(), []
    for n, kind, lines in blocks_of(text):
        for record in R.recognise(kind, n, lines):
            out += state.feed(record)
    out += state.drain()
    return [r for k, r in out if k == "command"], [r for k, r in out if k == "event"]


START = "2021/03/04 05:06:07 pid 4242 mona@mona-desk 10.20.30.40 [Desk Client/7.5.1] 'user-sync //...'"
#: The key of a command is a digest of its start line.
KEY = hashlib.md5(f"\t{START}".encode()).hexdigest()
BASIC = f"""
Perforce server info:
\t{START}
Perforce server info:
\t2021/03/04 05:06:07 pid 4242 compute end .047s
Perforce server info:
\t2021/03/04 05:06:07 pid 4242 completed .047s
"""
TRACK = """--- lapse .066s
--- usage 10+11us 12+13io 14+15net 5099k 22pf
--- memory cmd/proc 74mb/75mb
--- rpc msgs/size in+out 20+21/22mb+23mb himarks 271828/271829 snd/rcv .001s/.002s
--- filetotals (svr) send/recv files+bytes 25+1733mb/1+2mb
--- db.have
---   pages in+out+cached 1+2+3
---   pages split internal+leaf 41+42
---   locks read/write 4/5 rows get+pos+scan put+del 6+7+8 9+10
---   total lock wait+held read/write 12ms+13ms/14ms+-15ms
---   max lock wait+held read/write 32ms+33ms/34ms+35ms
---   peek count 20 wait+held total/max 21ms+22ms/23ms+24ms
--- lbr Rcs
---   opens+closes+checkins+exists 1+0+0+4
---   reads+readbytes+writes+writebytes 6+12.1K+0+3.3K
---   digests+filesizes+modtimes+copies 13+14+15+16
"""


def test_start_compute_complete():
    (c,), _ = parse(BASIC)
    assert c["processkey"] == KEY
    assert (c["lineNumber"], c["pid"], c["user"], c["args"], c["running"]) == (2, 4242, "mona", "//...", 1)
    assert round(c["computedLapse"], 3) == round(c["completedLapse"], 3) == 0.047
    assert c["startTime"] == c["endTime"] == datetime(2021, 3, 4, 5, 6, 7)


def test_track_fields():
    (c,), _ = parse(BASIC + f"Perforce server info:\n\t{START}\n{TRACK}")
    assert [c[n] for n in ("uCpu", "sCpu", "diskIn", "diskOut", "ipcIn", "ipcOut", "maxRss", "pageFaults")] == [10, 11, 12, 13, 14, 15, 5099, 22]
    assert (c["memMB"], c["memPeakMB"], c["rpcHimarkFwd"], c["fileTotalsSnd"], c["fileTotalsSndMB"], c["fileTotalsRcv"]) == (74, 75, 271828, 25, 1733, 1)
    assert (c["lbrRcsOpens"], c["lbrRcsReadBytes"], c["lbrRcsWriteBytes"], c["lbrRcsCopies"]) == (1, 12390, 3379, 16)
    (t,) = c["tables"]
    assert list(t.values()) == ["have", 1, 2, 3, 41, 42, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 32, 33, 34, 35, 20, 21, 22, 23, 24, 0.0]


@pytest.mark.parametrize(("text", "size"), [("12.1K", 12390), ("3.3K", 3379), ("12.1P", 13623389302292480), ("7", 7), ("x", 0), ("", 0)])
def test_byte_sizes(text, size):
    assert R.byte_size(text) == size


def test_unknown_section_closes_the_table():
    (c,), _ = parse(BASIC + f"Perforce server info:\n\t{START}\n--- db.monitor\n---   pages in+out+cached 1+2+3\n--- label/x\n---   pages in+out+cached 7+8+9\n")
    assert c["tables"][0]["pagesIn"] == 1


def test_storage_and_trigger_tables():
    (c,), _ = parse(f"\nPerforce server info:\n\t{START}\n--- storageup/storageup(R)\n---   total lock wait+held read/write 0ms+3ms/0ms+0ms\n--- storageup/storagemasterup(W)\n--- rdb.lbr\n")
    assert [t["tableName"] for t in c["tables"]] == ["rdb.lbr", "storagemasterup_W", "storageup_R"]
    (c,), _ = parse(f"\nPerforce server info:\n\t{START} trigger review.onsave\nlapse .066s\n")
    assert c["processkey"] == KEY
    assert c["tables"][0]["tableName"] == "trigger_review.onsave" and round(c["tables"][0]["triggerLapse"], 3) == 0.066
    (c,), _ = parse(f"\nPerforce server info:\n\t{START} trigger last.line\n")
    assert c["tables"] == []


def test_duplicate_starts_get_the_line_in_the_key():
    line = "2022/07/08 09:10:11 pid 3131 nils@ws 10.9.8.7 [app] 'rmt-FileFetch x'"
    commands, _ = parse(f"\nPerforce server info:\n\t{line}\n\nPerforce server info:\n\t{line}\n")
    first, second = sorted(commands, key=lambda c: c["lineNumber"])
    assert second["processkey"] == f"{first['processkey']}.{second['lineNumber']}"
    assert first["endTime"] == first["startTime"]


def test_orphan_completion_takes_the_track():
    line = "2019/11/12 13:14:15 pid 20202 u@w 1.2.3.4 [app] 'user-login -s'"
    (c,), _ = parse(f"\n\n\nPerforce server info:\n\t2019/11/12 13:14:16 pid 20202 completed .008s\nPerforce server info:\n\t{line}\n--- lapse .009s\n--- failed authentication check\n")
    assert (c["lineNumber"], c["cmd"], c["error"]) == (4, "user-login", True)


def test_errors_and_aborts():
    (c,), _ = parse(f"\nPerforce server info:\n\t{START}\n\nPerforce server error:\n\tPid 4242\n\tnot allowed\n")
    assert c["error"] and c["endTime"] is None
    assert parse("\nPerforce server info:\n\t2018/01/02 03:04:05 pid 777 u@w 1.1.1.1 [a] 'IDLE' exited unexpectedly, removed from monitor table.\n") == ([], [])
    (c,), _ = parse(f"{BASIC}\nPerforce server info:\n\t2021/03/04 05:06:08 pid 4242 u@w 1.1.1.1 [a] 'user-sync' exited unexpectedly, removed from monitor table.\n")
    assert c["error"]


def test_network_estimates_go_to_the_last_sync():
    text = f"\nPerforce server info:\n\t{START}\nPerforce server info:\n\t2021/03/04 05:06:07 pid 4242 compute end .020s\n"
    (c,), _ = parse(text + "Perforce server info:\n\tServer network estimates: files added/updated/deleted=1/2/3, bytes added/updated=4/5\n")
    assert [c[n] for n in ("netSyncFilesAdded", "netSyncFilesUpdated", "netSyncFilesDeleted", "netSyncBytesAdded", "netSyncBytesUpdated")] == [1, 2, 3, 4, 5]


def test_arguments():
    line = "2020/06/07 08:09:10 pid 6 u@w 1.1.1.1 [a] 'user-key -u k {\"a\":1}'"
    (c,), _ = parse(f"\nPerforce server info:\n\t{line}\n")
    assert c["args"] == "-u k"
    (c,), _ = parse("\nPerforce server info:\n\t2020/06/07 08:09:10 pid 6 u@w 1.1.1.1 [a] 'user-change -d First line\n\tmore text\n")
    assert (c["cmd"], c["args"]) == ("user-change", " -d First line")


def test_server_events():
    text = """
2023/02/03 04:05:06 111222333 pid 9090: Server is now using 137 active threads.
2023/02/03 04:05:06 111333444 pid 9090: Server now has 10 paused threads.
2023/02/03 04:05:16 000555666 pid 9091: Server under resource pressure.  Pause rate CPU 59%, mem 20%, CPU pressure 2, mem pressure 1
"""
    _, (a, p, r) = parse(text)
    assert (a["lineNumber"], a["activeThreads"], a["activeThreadsMax"]) == (2, 137, 137)
    assert (p["pausedThreads"], p["pausedThreadsMax"]) == (10, 10)
    assert (r["pauseRateCPU"], r["pauseRateMem"], r["cpuPressureState"], r["memPressureState"]) == (59, 20, 2, 1)


def test_headers_that_are_indented_end_no_block():
    commands, _ = parse("\nstray\n\tPerforce server info:\n\t2021/03/04 05:06:07 pid 1 compute end 1s\n" + BASIC)
    assert len(commands) == 1


def test_replaced_command_of_the_same_process():
    other = START.replace("user-sync //...", "dm-SubmitChange").replace("05:06:07", "05:06:10")
    commands, _ = parse(BASIC + f"Perforce server info:\n\t{other}\n")
    assert [c["cmd"] for c in commands] == ["user-sync", "dm-SubmitChange"]


def test_spark_equals_the_plain_fold(spark):
    from timberline.operators.tables import build_tables, parse_log
    from timberline.sources.logs import lines_of_text

    text = BASIC + f"Perforce server info:\n\t{START}\n{TRACK}\nRpc himark: x\nstray\n" + "2023/02/03 04:05:06 111222333 pid 9090: Server is now using 137 active threads.\n\n" + BASIC.replace("4242", "17").replace("05:06", "05:07")
    commands, events = parse(text)
    tables = build_tables(parse_log(lines_of_text(spark, text)))
    got = sorted((r["processkey"], r["lineNumber"], r["running"]) for r in tables.process.collect())
    assert got == sorted((c["processkey"], c["lineNumber"], c["running"]) for c in commands)
    assert tables.table_use.count() == sum(len(c["tables"]) for c in commands)
    assert [r["activeThreads"] for r in tables.events.collect()] == [e["activeThreads"] for e in events]


def test_invalid_utf8_keeps_the_key_of_the_raw_bytes(spark):
    from timberline.operators.tables import build_tables, parse_log
    from timberline.sources.logs import lines_of_text

    raw = START.encode().replace(b"Client", b"Cli\xffent")
    text = (b"Perforce server info:\n\t" + raw).decode("utf-8", "surrogateescape")
    (row,) = build_tables(parse_log(lines_of_text(spark, text))).process.collect()
    assert row["processkey"] == hashlib.md5(b"\t" + raw).hexdigest()


def test_line_numbers_run_over_files_and_splits(spark, tmp_path):
    from timberline.sources.logs import read_lines

    for name, n in (("a.log", 3000), ("b.log", 10)):
        (tmp_path / name).write_text("".join(f"{name} {i}\r\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = read_lines(spark, [f"file://{tmp_path}/a.log", f"file://{tmp_path}/b.log"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [r["value"] for r in sorted(rows, key=lambda r: r["line_no"])]
    assert [r for r in got] == [f"a.log {i}" for i in range(3000)] + [f"b.log {i}" for i in range(10)]
    assert sorted(r["line_no"] for r in rows) == list(range(1, 3011))


def test_gzip_without_a_suffix_and_long_lines(spark, tmp_path):
    import gzip

    from timberline.sources.logs import read_gzip_by_content

    (tmp_path / "log").write_bytes(gzip.compress(b"one\n" + b"x" * 6000 + b"\n"))
    rows = sorted(read_gzip_by_content(spark, [f"file://{tmp_path}/log"]).collect(), key=lambda r: r["line_no"])
    assert rows[0]["value"] == "one" and rows[1]["value"] == "x" * 5000 + "...'"


def test_lone_carriage_returns_end_no_line(spark, tmp_path):
    from timberline.sources.logs import read_gzip_by_content, read_lines

    (tmp_path / "log").write_bytes(b"one\rtwo\r\nthree\n")
    for read in (read_lines, read_gzip_by_content):
        rows = sorted(read(spark, [f"file://{tmp_path}/log"]).collect(), key=lambda r: r["line_no"])
        assert [r["value"] for r in rows] == ["one\rtwo", "three"]


def test_files_of_one_name_keep_their_order(spark, tmp_path):
    import gzip

    from timberline.sources.logs import read_gzip_by_content

    for i, folder in enumerate("ba"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s").write_bytes(gzip.compress(f"{i}a\n{i}b\n".encode()))
    rows = sorted(read_gzip_by_content(spark, [f"file://{tmp_path}/b/s", f"file://{tmp_path}/a/s"]).collect(), key=lambda r: r["line_no"])
    assert [(r["line_no"], r["value"]) for r in rows] == [(1, "0a"), (2, "0b"), (3, "1a"), (4, "1b")]


def test_runs_of_any_size_give_the_same(spark, monkeypatch):
    """Blocks that runs of lines cut in two are put together again."""
    from timberline.operators import correlate
    from timberline.operators.tables import build_tables, parse_log
    from timberline.sources.logs import lines_of_text

    text = BASIC + f"Perforce server info:\n\t{START}\n{TRACK}\nRpc himark: x\nstray\n2023/02/03 04:05:06 111222333 pid 9090: Server is now using 137 active threads.\n" + BASIC.replace("4242", "17").replace("05:06", "05:07")
    rows = lambda: sorted(map(str, build_tables(parse_log(lines_of_text(spark, text))).process.collect()))
    whole = rows()
    assert len(whole) == 2
    for size in (1, 2, 7):
        monkeypatch.setattr(correlate, "RUN_LINES", size)
        assert rows() == whole

"""Small logs for the rarer rules of the parser: each bound order is a log of its own that plays one of a query's cases.

A case has the log's lines and the rows that the rules give for them, both as templates: ``<...>`` is an SQL expression
over the order, in the part of SQL that Spark and DuckDB share. ``s0``, ``s5`` and so on are seconds after the order's start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after the start that templates may name.
SECONDS = (0, 1, 3, 4, 5, 9, 11)
HEAD, ERROR_HEAD = "Perforce server info:", "Perforce server error:"

#: Columns of the expected rows, with what they hold unless a row says otherwise.
DEFAULTS = {
    "computedLapse": "0.0e0", "completedLapse": "0.0e0", "paused": "0.0e0", "error": "false", "running": "1",
    "uCpu": "0", "fileTotalsSnd": "0", "netSyncFilesAdded": "0", "netSyncBytesUpdated": "0",
}


def cat(template: str) -> str:
    """The template as an SQL expression of type string."""
    parts = re.split(r"<(.*?)>", template)
    quoted = [f"cast({p} AS string)" if i % 2 else "'" + "', chr(39), '".join(p.split("'")) + "'" for i, p in enumerate(parts)]
    return f"concat({', '.join(quoted)})"


def start(at: int, command: str = "user-fstat //depot/<k>", pid: str = "k", after: str = "'") -> str:
    return f"\t<s{at}> pid <{pid}> user<k % 50>@ws<k % 20> 10.0.0.<k % 200> [app/<k % 5>] '{command}{after}"


def completed(at: int, lapse: str, pid: str = "k", more: str = "") -> str:
    return f"\t<s{at}> pid <{pid}> completed {lapse}s{more}"


@dataclass
class Row:
    """An expected command: its header's line, its start line (empty: none was seen) and what differs from DEFAULTS."""

    line: int
    text: str
    at: int | None = 0
    end: int | None = None
    duplicate: bool = False
    values: dict[str, str] = field(default_factory=dict)

    def sql(self) -> dict[str, str]:
        key = f"md5({cat(self.text)})" if self.text else "''"
        m = re.search(r"pid <(.*?)> .*? '([\w-]+) ?([^'{]*)", self.text)
        pid, cmd, args = m.groups() if m else ("k", "", "")
        moment = lambda n: "cast(NULL AS timestamp)" if n is None else f"started + to_seconds({n})"
        own = {"lineNumber": str(self.line), "processkey": f"concat({key}, '.{self.line}')" if self.duplicate else key, "pid": pid, "cmd": cat(cmd), "args": cat(args.rstrip()), "startTime": moment(self.at), "endTime": moment(self.end)}
        return own | DEFAULTS | self.values


@dataclass
class Case:
    name: str
    lines: list[str]
    rows: list[Row] = field(default_factory=list)
    #: Expected rows of other tables, by column.
    others: list[dict[str, str]] = field(default_factory=list)


def lines_of(spark: SparkSession, sf_dir: str, cases: list[Case]) -> DataFrame:
    """(log_id, line_no, value)"""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "timestampadd(SECOND, cast((o_orderkey * 37) % 86400 as int), o_orderdate) AS started")
    orders = orders.selectExpr("k", *(f"date_format(timestampadd(SECOND, {n}, started), 'yyyy/MM/dd HH:mm:ss') AS s{n}" for n in SECONDS))
    which = F.expr(f"k % {len(cases)}")
    texts, name = F.lit(None), F.lit(None)
    for i, case in enumerate(cases):
        texts = F.when(which == i, F.array(*(F.expr(cat(line)) for line in case.lines))).otherwise(texts)
        name = F.when(which == i, F.lit(case.name)).otherwise(name)
    rows = orders.select(F.concat(name, F.lit("-"), F.col("k")).alias("log_id"), F.posexplode(texts).alias("i", "value"))
    return rows.select("log_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "value")


def _twin(cases: list[Case], rows_of) -> str:
    moments = ", ".join(f"strftime(started + to_seconds({n}), '%Y/%m/%d %H:%M:%S') AS s{n}" for n in SECONDS)
    orders = f"SELECT *, {moments} FROM (SELECT o_orderkey AS k, o_orderdate + to_seconds(cast((o_orderkey * 37) % 86400 AS bigint)) AS started FROM orders)"
    parts = [
        f"SELECT '{case.name}-' || k AS log_id, " + ", ".join(f"{v} AS {c}" for c, v in row.items()) + f" FROM o WHERE k % {len(cases)} = {i}"
        for i, case in enumerate(cases) for row in rows_of(case)
    ]
    return f"WITH o AS ({orders}) " + " UNION ALL ".join(parts)


def process_twin(cases: list[Case]) -> str:
    return _twin(cases, lambda case: [row.sql() for row in case.rows])


def order_twin(cases: list[Case]) -> str:
    """The commands in the order in which they leave the fold, which is that of the case's rows."""
    return _twin(cases, lambda case: [{"emitted": str(i), "lineNumber": str(row.line), "processkey": row.sql()["processkey"], "endTime": row.sql()["endTime"]} for i, row in enumerate(case.rows)])


def others_twin(cases: list[Case]) -> str:
    return _twin(cases, lambda case: case.others)


PROCESS_COLUMNS = ("log_id", *Row(1, "").sql())

_TRACK = ["--- lapse 1.5s", "--- db.have"]
_PLAIN = start(0)
_OTHER, _THIRD = "k + 100000000", "k + 200000000"

#: Starts of a process that already has a command, by the rule that decides.
DECISIONS = [
    Case("d01", [HEAD, _PLAIN, "", HEAD, start(1, "user-edit //x"), "--- lapse 1.5s"], [Row(1, _PLAIN)]),
    Case("d02", [HEAD, _PLAIN, "", HEAD, start(1, "user-edit //x")], [Row(1, _PLAIN), Row(4, start(1, "user-edit //x"), 1)]),
    Case("d03", [HEAD, _PLAIN, "", HEAD, start(1, "user-edit //x"), "--- rdb.lbr"], [Row(1, _PLAIN)]),
    Case("d04", [HEAD, start(0, "rmt-FileFetch a"), "", HEAD, start(0, "rmt-FileFetch a")], [Row(1, start(0, "rmt-FileFetch a"), 0, 0, values={"running": "0"}), Row(4, start(0, "rmt-FileFetch a"), 0, 0, True, {"running": "0"})]),
    Case("d05", [HEAD, _PLAIN, "", HEAD, _PLAIN, *_TRACK, "", HEAD, _PLAIN, "--- lapse 3.25s"], [Row(1, _PLAIN, 0, 1, values={"completedLapse": "1.5e0"}), Row(9, _PLAIN, 0, 3, True, {"completedLapse": "3.25e0"})]),
    Case("d06", [HEAD, _PLAIN, "", HEAD, _PLAIN, "--- lapse 3.25s"], [Row(1, _PLAIN, 0, 3, values={"completedLapse": "3.25e0"})]),
    Case("d07", [HEAD, _PLAIN, "", HEAD, _PLAIN, *_TRACK, "", HEAD, _PLAIN], [Row(1, _PLAIN, 0, 1, values={"completedLapse": "1.5e0"}), Row(9, _PLAIN, 0, None, True)]),
    Case("d08", [HEAD, _PLAIN, "", HEAD, _PLAIN, "--- db.have", "---   pages in+out+cached 1+2+3"], [Row(1, _PLAIN)]),
    Case("d09", [HEAD, _PLAIN, "", HEAD, _PLAIN, "--- meta/x(R)"], [Row(1, _PLAIN)]),
    Case("d10", [HEAD, _PLAIN, "", HEAD, _PLAIN, "", HEAD, completed(1, "1.25")], [Row(1, _PLAIN), Row(4, _PLAIN, 0, 1, True, {"completedLapse": "1.25e0"})]),
    # Tracking of the command alone leaves it open for more; with tables too, the next start is a new command.
    Case("d11", [HEAD, _PLAIN, "", HEAD, _PLAIN, "--- lapse 1.5s", "", HEAD, _PLAIN, "--- lapse 3.25s"], [Row(1, _PLAIN, 0, 3, values={"completedLapse": "3.25e0"})]),
    # The process was seen in this second and its command has left: what comes is a duplicate.
    Case("d12", [HEAD, start(0, "user-info", _OTHER), HEAD, start(1), HEAD, completed(1, "0.5"), HEAD, start(1), *_TRACK, HEAD, start(1)],
         [Row(1, start(0, "user-info", _OTHER)), Row(3, start(1), 1, 1, values={"completedLapse": "1.5e0", "running": "2"}), Row(11, start(1), 1, None, True, {"running": "2"})]),
]

_KEYED = "user-key -u name"
_UNENDING = {"endTime": "started", "running": "0"}

#: Forms of the start line.
STARTS = [
    Case("r02", [HEAD, start(0, "user-info")], [Row(1, start(0, "user-info"))]),
    Case("r03", [HEAD, start(0, "user-change -d line <k>", after=""), "\tand more"], [Row(1, start(0, "user-change -d line <k>", after=""), values={"args": cat(" -d line <k>")})]),
    Case("r07", [HEAD, start(0, _KEYED + ' {"a":<k>}')], [Row(1, start(0, _KEYED + ' {"a":<k>}'))]),
    Case("r08", [HEAD, start(0, after="' trigger check.<k % 9>"), "lapse 1.5s"], [Row(1, _PLAIN)]),
    Case("r16", [HEAD, start(0, "pull -u -i 1")], [Row(1, start(0, "pull -u -i 1"), values=_UNENDING)]),
    Case("r16b", [HEAD, start(0, "pull -u 1")], [Row(1, start(0, "pull -u 1"))]),
    *(Case(f"r17{c}", [HEAD, start(0, f"{c} x")], [Row(1, start(0, f"{c} x"), values=_UNENDING)]) for c in ("rmt-FileFetch", "rmt-FileFetchMulti", "rmt-JournalPos", "client-Stats")),
]

_SYNC = start(0, "user-sync //...")

#: Records that change a running command, and lines of tracking about the command itself.
UPDATES = [
    Case("r06", [HEAD, _PLAIN, HEAD, completed(1, "1.25", more=" <k % 90 + 1>+11us 12+13io 14+15net 5099k 22pf")], [Row(1, _PLAIN, 0, 1, values={"completedLapse": "1.25e0", "uCpu": "k % 90 + 1"})]),
    Case("r10", [HEAD, _PLAIN, "", HEAD, start(1, "user-fstat", after="' exited unexpectedly, removed from monitor table.")], [Row(1, _PLAIN, 0, 0, values={"error": "true"})]),
    Case("r11", [HEAD, _SYNC, HEAD, "\t<s0> pid <k> compute end .5s", HEAD, "\tServer network estimates: files added/updated/deleted=<k % 9 + 1>/2/3, bytes added/updated=4/<k % 7 + 1>"],
         [Row(1, _SYNC, values={"computedLapse": "0.5e0", "netSyncFilesAdded": "k % 9 + 1", "netSyncBytesUpdated": "k % 7 + 1"})]),
    # Estimates go to the last sync that was computed, not to other commands.
    Case("c06", [HEAD, _PLAIN, HEAD, "\t<s0> pid <k> compute end .5s", HEAD, "\tServer network estimates: files added/updated/deleted=1/2/3, bytes added/updated=4/5"], [Row(1, _PLAIN, values={"computedLapse": "0.5e0"})]),
    Case("r12", [HEAD, _PLAIN, "", ERROR_HEAD, "\tPid <k>", "\tno such file"], [Row(1, _PLAIN, values={"error": "true"})]),
    Case("c04", [HEAD, completed(5, "3.5")], [Row(1, "", 2, 5, values={"completedLapse": "3.5e0", "running": "0"})]),
    Case("t02", [HEAD, _PLAIN, HEAD, _PLAIN, "--- paused .75s"], [Row(1, _PLAIN, values={"paused": "0.75e0"})]),
    Case("t03", [HEAD, _PLAIN, HEAD, _PLAIN, "--- exited on fatal server error"], [Row(1, _PLAIN, values={"error": "true"})]),
    Case("t04", [HEAD, _PLAIN, HEAD, _PLAIN, "--- failed authentication check"], [Row(1, _PLAIN, values={"error": "true"})]),
    Case("t13", [HEAD, _PLAIN, HEAD, _PLAIN, "--- filetotals (client) send/recv files+bytes <k % 30 + 1>+2mb/3+4mb"], [Row(1, _PLAIN, values={"fileTotalsSnd": "k % 30 + 1"})]),
    # What another process does leaves the command as it is.
    Case("c05", [HEAD, _PLAIN, "", ERROR_HEAD, f"\tPid <{_OTHER}>", "", HEAD, f"\t<s1> pid <{_OTHER}> compute end .5s"], [Row(1, _PLAIN)]),
]

_P, _B = "user-info", "user-files //b"


def _flushed(name: str, rest: list[str], a: str, b_at: int, rows: list[Row], p_at: int = 0) -> Case:
    """A pending command, then A and what follows it, then B, which makes the fold look for commands to let go."""
    lines = [HEAD, start(p_at, _P, _OTHER), HEAD, a, *rest]
    return Case(name, [*lines, HEAD, start(b_at, _B, _THIRD)], [*rows, Row(len(lines) + 1, start(b_at, _B, _THIRD), b_at)])


_PENDING = Row(1, start(0, _P, _OTHER))
_FETCH = start(0, "rmt-FileFetch a")
_DONE = [HEAD, completed(0, ".5"), HEAD, _PLAIN, *_TRACK]

#: Which commands leave the fold before the end of the log, in order.
FLUSHES = [
    _flushed("w00", _DONE, _PLAIN, 0, [_PENDING, Row(3, _PLAIN, 0, 0)]),
    _flushed("w01", _DONE, _PLAIN, 1, [Row(3, _PLAIN, 0, 0), _PENDING]),
    Case("w02", [HEAD, start(0, _P, _OTHER), HEAD, start(0, "rmt-FileFetch a", _THIRD), HEAD, _PLAIN, HEAD, start(3, "user-info", "k + 300000000"), HEAD, completed(1, "1.0"), HEAD, start(5, "user-info", "k + 400000000")],
         [Row(3, start(0, "rmt-FileFetch a", _THIRD), 0, 0), Row(5, _PLAIN, 0, 1), _PENDING, Row(7, start(3, "user-info", "k + 300000000"), 3), Row(11, start(5, "user-info", "k + 400000000"), 5)]),
    _flushed("w03", [HEAD, completed(9, "9.0")], _PLAIN, 5, [Row(3, _PLAIN, 0, 9), _PENDING]),
    _flushed("w04", [HEAD, _PLAIN, *_TRACK], _PLAIN, 5, [Row(3, _PLAIN, 0, 1), _PENDING]),
    _flushed("w05", [], _FETCH, 5, [Row(3, _FETCH, 0, 0), _PENDING]),
    # Two that leave at once do so in line order, whichever was completed first.
    Case("w06", [HEAD, start(0, _P, _OTHER), HEAD, _PLAIN, HEAD, start(0, "user-sync a", _THIRD), HEAD, completed(1, "1.0", _THIRD), HEAD, completed(1, "1.0"), HEAD, start(5, "user-info", "k + 300000000")],
         [Row(3, _PLAIN, 0, 1), Row(5, start(0, "user-sync a", _THIRD), 0, 1), _PENDING, Row(11, start(5, "user-info", "k + 300000000"), 5)]),
    # Tracking that comes after its command has left is a command again.
    Case("w07", [HEAD, _PLAIN, HEAD, completed(1, "1.0"), HEAD, start(5, _B, _OTHER), HEAD, _PLAIN, "--- lapse 1.0s", "--- db.have"],
         [Row(1, _PLAIN, 0, 1), Row(5, start(5, _B, _OTHER), 5), Row(7, _PLAIN, 0, 1)]),
]

#: Without completion records all commands leave by their start times.
NO_COMPLETION = [_flushed("w09", [], _PLAIN, 5, [Row(3, _PLAIN), Row(1, start(4, _P, _OTHER), 4)], p_at=4)]
#: With ten seconds between two flushes the second start finds nothing to do.
SLOW = [_flushed("w10", _DONE, _PLAIN, 5, [_PENDING, Row(3, _PLAIN, 0, 0)])]

#: Counters of a table; the rest are 0.
TABLE_DEFAULTS = dict.fromkeys(("pagesIn", "pagesSplitLeaf", "scanRows", "totalWriteHeld", "maxReadWait", "maxWriteHeld", "peekCount", "maxPeekHeld"), "0") | {"triggerLapse": "0.0e0"}


def _table(name: str, **values: str) -> dict[str, str]:
    return {"processkey": f"md5({cat(_PLAIN)})", "lineNumber": "1", "tableName": cat(name)} | TABLE_DEFAULTS | values


_PAGES, _MAX = "---   pages in+out+cached <k % 31 + 1>+2+3", "---   max lock wait+held read/write <k % 32>ms+33ms/34ms+<k % 35>ms"

#: Sections of tables; sections that are not known, or not counted, end the one before.
SECTIONS = [
    Case("t05", [HEAD, _PLAIN, "--- db.have", _PAGES, "---   pages split internal+leaf 41+<k % 42>", "---   locks read/write 4/5 rows get+pos+scan put+del 6+7+<k % 8> 9+10",
                 "---   total lock wait+held read/write 12ms+13ms/14ms+-<k % 15>ms", _MAX, "---   peek count <k % 20> wait+held total/max 21ms+22ms/23ms+<k % 24>ms"],
         others=[_table("have", pagesIn="k % 31 + 1", pagesSplitLeaf="k % 42", scanRows="k % 8", totalWriteHeld="k % 15", maxReadWait="k % 32", maxWriteHeld="k % 35", peekCount="k % 20", maxPeekHeld="k % 24")]),
    Case("t06", [HEAD, _PLAIN, "--- rdb.lbr", _PAGES, "--- db.rev", _MAX], others=[_table("rdb.lbr", pagesIn="k % 31 + 1"), _table("rev", maxReadWait="k % 32", maxWriteHeld="k % 35")]),
    Case("t07", [HEAD, _PLAIN, "--- storageup/storageup(R)", _PAGES, "--- storageup/storagemasterup(W)", _MAX, "--- storageup/plain"],
         others=[_table("storageup_R", pagesIn="k % 31 + 1"), _table("storagemasterup_W", maxReadWait="k % 32", maxWriteHeld="k % 35"), _table("plain")]),
    *(Case(f"t08{i}", [HEAD, _PLAIN, "--- db.have", _PAGES, f"--- {section}", "---   pages in+out+cached 77+8+9"], others=[_table("have", pagesIn="k % 31 + 1")])
      for i, section in enumerate(("meta/x(R)", "change/x", "clients/<k>(W)", "clientEntity/x", "replica/pull(R)"))),
    Case("t18", [HEAD, _PLAIN, "--- db.monitor", _PAGES, "--- label/x", "---   pages in+out+cached 77+8+9"], others=[_table("monitor", pagesIn="k % 31 + 1")]),
    Case("r09", [HEAD, start(0, after="' trigger check.<k % 9>"), "lapse 1.5s"], others=[_table("trigger_check.<k % 9>", triggerLapse="1.5e0")]),
]

_N1, _WAITING = "20 + k % 7", "3 + k % 3"
EVENT_COLUMNS = ("lineNumber", "eventTime", "activeThreads", "activeThreadsMax", "pausedThreads", "pausedThreadsMax", "pausedErrorCount", "pauseRateCPU", "pauseRateMem", "cpuPressureState", "memPressureState")


def _event(*values: str) -> dict[str, str]:
    return dict(zip(EVENT_COLUMNS, values, strict=True))


#: Server events: counts between absolute ones, and maxima that start again when over ten seconds have passed.
EVENTS = [
    Case("e07", [HEAD, _SYNC, f"<s0> 111 pid 9: Server is now using <{_N1}> active threads.", "<s0> 111 pid 9: Server is now using 5 active threads.", f"<s0> 111 pid 9: Server now has <{_WAITING}> paused threads.",
                 HEAD, start(11, _B, _OTHER), "<s11> 111 pid 9: Server is now using 3 active threads.", HEAD, start(11, _B, _OTHER), "--- lapse 1.5s", "--- paused .5s", "--- exited on fatal server error",
                 "<s11> 111 pid 9: Server under resource pressure.  Pause rate CPU 59%, mem <k % 20>%, CPU pressure 2, mem pressure 1"],
         others=[_event("3", "started", _N1, _N1, "0", "0", "0", "0", "0", "0", "0"), _event("4", "started", "5", _N1, "0", "0", "0", "0", "0", "0", "0"), _event("5", "started", "5", _N1, _WAITING, _WAITING, "0", "0", "0", "0", "0"),
                 _event("8", "started + to_seconds(11)", "3", "3", _WAITING, _WAITING, "0", "0", "0", "0", "0"), _event("14", "started + to_seconds(11)", "3", "3", f"{_WAITING} - 1", _WAITING, "1", "59", "k % 20", "2", "1")]),
    # A start is counted before the next absolute count, and a completion taken off.
    Case("e02", [HEAD, _SYNC, HEAD, start(0, _B, _OTHER), "<s0> 111 pid 9: Server now has 2 paused threads.", HEAD, completed(0, ".5"), "<s0> 111 pid 9: Server now has 1 paused threads."],
         others=[_event("5", "started", "2", "2", "2", "2", "0", "0", "0", "0", "0"), _event("8", "started", "1", "2", "1", "2", "0", "0", "0", "0", "0")]),
]

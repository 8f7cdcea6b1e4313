"""Correlation of records into commands: the one ordered, stateful stage.

``records_of`` frames and recognises runs of lines, in parallel within a log too; what leaves a run is small records
and the lines of blocks that are cut by its edges. ``Correlator`` holds the running command of each process id and a few
clocks. ``correlate`` streams the records of each log through it in line order with memory for the running commands only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.framing import RUN_LINES, Framer
from timberline.operators.records import is_block_end, is_real_table, lacks_completion, new_command, packed, recognise, unpacked
from timberline.plans import schemas as S

#: Running commands beyond which a log is taken to lack completion records.
MOST_RUNNING = 20_000
LATE = timedelta(seconds=3)
EVENT_WINDOW = timedelta(seconds=10)


@dataclass
class Options:
    """``output_every``: least time between two flushes. ``no_completion_records``: flush all commands by start time."""

    output_every: timedelta = timedelta(seconds=1)
    no_completion_records: bool = False


def _since(now: datetime | None, then: datetime | None) -> timedelta:
    if now is None:
        return timedelta.min if then is not None else timedelta(0)
    return timedelta.max if then is None else now - then


@dataclass
class Correlator:
    options: Options = field(default_factory=Options)
    held: dict[int, dict] = field(default_factory=dict)
    clock: datetime | None = None
    start_clock: datetime | None = None
    last_output: datetime | None = None
    seen_this_second: set[int] = field(default_factory=set)
    running: int = 0
    sync_pid: int | None = None
    paused: int = 0
    paused_errors: int = 0
    running_max: int = 0
    paused_max: int = 0
    last_event: datetime | None = None
    pressure: tuple[int, int, int, int] = (0, 0, 0, 0)
    out: list[tuple[str, dict]] = field(default_factory=list)

    def feed(self, record: tuple) -> list[tuple[str, dict]]:
        """Takes a record; returns what that completes: ("command" or "event", row)."""
        getattr(self, f"_{record[0]}")(*record[1:])
        out, self.out = self.out, []
        return out

    def drain(self) -> list[tuple[str, dict]]:
        """What is still held, in line order."""
        for command in sorted(self.held.values(), key=lambda c: c["lineNumber"]):
            self._emit(command)
        self.held.clear()
        out, self.out = self.out, []
        return out

    # Records

    def _start(self, new: dict, track: bool) -> None:
        if new["paused"] > 0 and self.paused > 0:
            self.paused -= 1
        if new.pop("fatal", False):
            self.paused_errors += 1
        self._add(new, track)

    def _compute(self, line_no: int, pid: int, lapse: float) -> None:
        if command := self.held.get(pid):
            command["computedLapse"] = lapse
            if command["cmd"] == "user-sync":
                self.sync_pid = pid

    def _completed(self, line_no: int, pid: int, end: datetime | None, lapse: float) -> None:
        if command := self.held.get(pid):
            command.update(endTime=end, completedLapse=lapse, completed=True)
            self._count(command, -1)
        else:
            self._add(new_command(line_no) | {"pid": pid, "endTime": end, "completedLapse": lapse, "completed": True}, False)

    def _usage(self, line_no: int, pid: int, values: tuple) -> None:
        if command := self.held.get(pid):
            command.update(zip(S.USAGE, values, strict=True))

    def _estimates(self, line_no: int, values: tuple) -> None:
        if command := self.held.get(self.sync_pid):
            command.update(zip(S.NET_SYNC, values, strict=True))

    def _error(self, line_no: int, pid: int) -> None:
        if command := self.held.get(pid):
            command["error"] = True
            if not self._unending(command):
                self._count(command, -1)

    def _abort(self, line_no: int, pid: int) -> None:
        if command := self.held.get(pid):
            command["completed"] = True
            command["endTime"] = command["endTime"] or command["startTime"]
            self._error(line_no, pid)

    def _active(self, line_no: int, at: datetime, n: int) -> None:
        self.running = n
        self._event(line_no, at)

    def _paused(self, line_no: int, at: datetime, n: int) -> None:
        self.paused = n
        self._event(line_no, at)

    def _pressure(self, line_no: int, at: datetime, *state: int) -> None:
        self.pressure = state
        self._event(line_no, at)

    # State

    def _event(self, line_no: int, at: datetime | None) -> None:
        self.paused_max, self.running_max = max(self.paused_max, self.paused), max(self.running_max, self.running)
        if self.clock is not None and _since(self.clock, self.last_event) > EVENT_WINDOW:
            self.paused_max, self.running_max, self.last_event = self.paused, self.running, self.clock
        values = (line_no, at, self.running, self.running_max, self.paused, self.paused_max, self.paused_errors, *self.pressure)
        self.out.append(("event", dict(zip(S.EVENT_COLUMNS, values, strict=True))))

    @staticmethod
    def _unending(command: dict) -> bool:
        return lacks_completion(command["cmd"], command["args"])

    def _count(self, command: dict, delta: int) -> None:
        if (delta > 0) != command["counted"]:
            self.running += delta
            command["counted"] = delta > 0
            if delta > 0:
                command["running"] = self.running
                if self.running > MOST_RUNNING:
                    raise ValueError(f"over {MOST_RUNNING} running commands; the log seems to lack completion records (option no_completion_records)")

    def _replace(self, old: dict, new: dict, duplicate: bool, count: bool = True) -> None:
        self._emit(old)
        new["duplicate"] = duplicate
        self.held[new["pid"]] = new
        if count:
            self._count(new, 1)

    def _add(self, new: dict, track: bool) -> None:
        names = new["tables"]
        real = new["table_track"] and any(map(is_real_table, names))
        new["ignored_tables"] |= bool(names) and not any(map(is_real_table, names))
        start, pid = new["startTime"], new["pid"]
        if start and (self.clock is None or start > self.clock):
            self.clock = start
        new["running"] = self.running
        if start and (self.start_clock is None or start > self.start_clock):
            self.start_clock = start
            self.seen_this_second = set()
        old = self.held.get(pid)
        if old is None:
            self.held[pid] = new
            new["duplicate"] = pid in self.seen_this_second and not real
            self.seen_this_second.add(pid)
            if not self._unending(new) and not new["completed"]:
                self._count(new, 1)
        elif old["processkey"] and old["processkey"] != new["processkey"]:
            # A new command of the process, unless it only tracks locks or storage of another time.
            if not (track and not real) and (not new["table_track"] or real):
                self._replace(old, new, False, not self._unending(new))
        elif self._unending(new):
            self._replace(old, new, True, False)
        else:
            if old["track"] and (track or not (new["table_track"] or new["ignored_tables"])) or not track and old["track"]:
                self._replace(old, new, True)
            elif track or new["table_track"]:
                self._merge(old, new)
            elif not new["ignored_tables"]:
                self._replace(old, new, True)
            if track and real:
                old["track"] = True
        self._flush()

    @staticmethod
    def _merge(old: dict, new: dict) -> None:
        for name in ("processkey", "startTime", "endTime", *S.IDENTITY):
            old[name] = old[name] or new[name]
        for name in (*S.SECONDS, *S.COUNTERS):
            if new[name] > 0:
                old[name] = new[name]
        old["error"] |= new["error"]
        old["table_track"] |= new["table_track"]
        old["tables"].update(new["tables"])

    def _flush(self) -> None:
        idle = _since(self.clock, self.last_output)
        if idle < self.options.output_every:
            return
        ready = [c for c in self.held.values() if self._is_ready(c, idle)]
        for command in sorted(ready, key=lambda c: c["lineNumber"]):
            del self.held[command["pid"]]
            self._emit(command)
        if ready or self.last_output is None:
            self.last_output = self.clock

    def _is_ready(self, c: dict, idle: timedelta) -> bool:
        late = lambda then: _since(self.start_clock, then) >= LATE
        if c["completed"] and (c["track"] or c["endTime"] and late(c["endTime"]) or self.last_output and idle >= LATE):
            return True
        end = c["endTime"] or (c["startTime"] + timedelta(seconds=int(c["completedLapse"])) if c["startTime"] and c["completedLapse"] else None)
        if c["track"] and end and late(end):
            return True
        return late(c["startTime"]) and (self._unending(c) or self.options.no_completion_records)

    def _emit(self, command: dict) -> None:
        self._count(command, -1)
        lapse = timedelta(seconds=int(command["completedLapse"]))
        if command["completedLapse"]:
            if command["endTime"] is None and command["startTime"]:
                command["endTime"] = command["startTime"] + lapse
            elif command["startTime"] is None and command["endTime"]:
                command["startTime"] = command["endTime"] - lapse
        if self.clock is not None and _since(self.clock, self.last_output) > timedelta(0):
            self.last_output = self.clock
        self.out.append(("command", finished(command, self._unending(command))))


def finished(command: dict, unending: bool) -> dict:
    """The row of a command: duplicates get their line number in the key, and tables are sorted by name."""
    row = {name: command[name] for name in S.PROCESS_COLUMNS}
    if command["duplicate"]:
        row["processkey"] = f"{row['processkey']}.{row['lineNumber']}"
    if unending:
        row["endTime"] = row["startTime"]
    row["tables"] = [dict(command["tables"][k]) for k in sorted(command["tables"])]
    return row


def records_of(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, place, record, raw) of lines (log_id, line_no, value), by runs of RUN_LINES line numbers.

    ``record`` is a packed record of the block that starts at ``line_no``. ``raw`` are the lines before a run's first
    block end, or those of its last block: whether that is complete, the next run tells.
    """
    run = F.floor(F.col("line_no") / RUN_LINES).cast("bigint")
    narrow = lines.where(F.col("value").isNotNull()).select("log_id", run.alias("run"), F.col("line_no").cast("bigint").alias("line_no"), F.col("value").cast("binary").alias("value"))
    ordered = narrow.repartition("log_id", "run").sortWithinPartitions("log_id", "run", "line_no")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, framer, edge, opened = None, Framer(), [], False

        def close(key: tuple) -> Iterator[tuple]:
            if edge:
                yield key[0], edge[0][0], 0, None, pickle.dumps(edge, pickle.HIGHEST_PROTOCOL)

        for batch in batches:
            logs, runs, numbers, values = (batch.column(i).to_pylist() for i in range(4))
            for log, run, n, value in zip(logs, runs, numbers, values, strict=True):
                if (log, run) != key:
                    if key:
                        yield from close(key)
                    key, framer, edge, opened = (log, run), Framer(), [], False
                line = value.decode("utf-8", "surrogateescape")
                if is_block_end(line):
                    if not opened:
                        yield from close(key)
                    opened, edge = True, []
                edge.append((n, line))
                if opened and (block := framer.feed(n, line)):
                    for place, record in enumerate(recognise(block[1], block[0], block[2])):
                        yield log, block[0], place, packed(record), None
        if key:
            yield from close(key)

    schema = pa.schema([("log_id", pa.string()), ("line_no", pa.int64()), ("place", pa.int32()), ("record", pa.binary()), ("raw", pa.binary())])

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run_all, "log_id string, line_no bigint, place int, record binary, raw binary")


def correlate(records: DataFrame, options: Options | None = None) -> DataFrame:
    """(log_id, emitted, command, event) of ``records_of`` lines.

    Logs are independent; within one, the order decides the result, so its records pass through one task,
    as a stream. ``emitted`` numbers the output of a log.
    """
    options = options or Options()
    ordered = records.repartition("log_id").sortWithinPartitions("log_id", "line_no", "place")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(S.OUTPUT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        log, state, framer, n = None, None, Framer(), 0

        def put(results: list[tuple[str, dict]]) -> None:
            nonlocal n
            for kind, row in results:
                held.append({"log_id": log, "emitted": n, "command": None, "event": None, kind: row})
                n += 1

        def put_block(block: tuple[int, str, list[str]] | None) -> None:
            for record in recognise(block[1], block[0], block[2]) if block else ():
                put(state.feed(record))

        def finish() -> None:
            put_block(framer.close())
            put(state.drain())

        for batch in batches:
            for name, record, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or name != log:
                    if state:
                        finish()
                    log, state, framer, n = name, Correlator(options), Framer(), 0
                if raw is not None:
                    for line_no, line in pickle.loads(raw):
                        put_block(framer.feed(line_no, line))
                else:
                    put_block(framer.close())
                    put(state.feed(unpacked(record)))
                if len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(_clean(held), schema=schema)
                    held = []
        if state:
            finish()
        if held:
            yield pa.RecordBatch.from_pylist(_clean(held), schema=schema)

    return ordered.mapInArrow(run, S.OUTPUT_SCHEMA)


def _clean(rows: list[dict]) -> list[dict]:
    """Bytes that are not UTF-8 become replacement characters in the output; keys were made from the raw bytes."""
    for row in rows:
        if command := row["command"]:
            for name in S.IDENTITY:
                if not command[name].isascii():
                    command[name] = command[name].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return rows

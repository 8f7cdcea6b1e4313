"""Live logs: the correlation as a stateful streaming query, and metrics published by trigger.

Start records define time but tracking repeats old start times, so records count in the order of their line
numbers within a log, and no watermark drops any. The state of a log is its running commands, its clocks
and the open block.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from timberline.operators import records as R
from timberline.operators.correlate import Correlator, Options
from timberline.operators.framing import Framer

OUTPUT = "log_id string, emitted bigint, kind string, row string"


class LiveLog:
    """Framing and correlation of one log, line by line; what it holds can be pickled between batches."""

    def __init__(self, options: Options):
        self.correlator, self.framer, self.emitted = Correlator(options), Framer(), 0

    def feed(self, line_no: int, line: str) -> list[tuple[str, dict]]:
        return self._taken(self.framer.feed(line_no, line.rstrip("\r\n")))

    def close(self) -> list[tuple[str, dict]]:
        return self._taken(self.framer.close())

    def _taken(self, block: tuple[int, str, list[str]] | None) -> list[tuple[str, dict]]:
        return [found for record in (R.recognise(block[1], block[0], block[2]) if block else ()) for found in self.correlator.feed(record)]


def _text(value):
    return value.strftime("%Y/%m/%d %H:%M:%S") if isinstance(value, datetime) else value


def live_commands(lines: DataFrame, options: Options | None = None, idle: str | None = None) -> DataFrame:
    """(log_id, emitted, kind, row) of streaming lines (log_id, line_no, value); ``row`` is the command or event as JSON.

    With ``idle`` (a duration), a log without lines for so long is drained: its open commands are put out
    and its state goes.
    """
    options = options or Options()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = pickle.loads(state.get[0]) if state.exists else LiveLog(options)
        found: list[tuple[str, dict]] = []
        if state.hasTimedOut:
            found = log.close() + log.correlator.drain()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("line_no", kind="stable")
            for n, value in zip(rows["line_no"].tolist(), rows["value"].tolist(), strict=True):
                found += log.feed(n, value)
        out = []
        for kind, row in found:
            out.append((key[0], log.emitted, kind, json.dumps({k: _text(v) for k, v in row.items()}, default=str)))
            log.emitted += 1
        if not state.hasTimedOut:
            state.update((pickle.dumps(log),))
            if idle:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["log_id", "emitted", "kind", "row"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return lines.groupBy("log_id").applyInPandasWithState(step, OUTPUT, "log binary", "append", timeout)


def publish(commands: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "10 seconds"):
    """Starts the query that hands each interval's commands and events to ``write``; exactly once with an idempotent writer."""
    return commands.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def live_counters(commands: DataFrame) -> DataFrame:
    """Counter and seconds by command so far, for complete-mode sinks."""
    from pyspark.sql import functions as F

    rows = commands.where("kind = 'command'")
    field = lambda name: F.get_json_object("row", f"$.{name}")
    return rows.groupBy(field("cmd").alias("cmd")).agg(F.count("*").alias("p4_cmd_counter"), F.sum(field("completedLapse").cast("double")).alias("p4_cmd_cumulative_seconds"))

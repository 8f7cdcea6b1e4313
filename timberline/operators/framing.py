"""Lines to blocks: the text between two block ends, typed by its first line.

``frame`` does it for a table of lines, ``Framer`` line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators import records as R
from timberline.sources.logs import carried

#: Lines in which a window looks for the last block end.
RUN_LINES = 100_000

_EVENT = r"(?d)^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d \d+ pid \d+: "


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | value.startswith(p)
    return found


def is_ignored(value: Column) -> Column:
    return starts_with_any(value, R.IGNORED_PREFIXES)


def is_event(value: Column) -> Column:
    """One-line server events: a cheap test of the text first, then the pattern."""
    active = value.endswith(R.ACTIVE_SUFFIX) & value.rlike(_EVENT + r"Server is now using \d+ active threads\.")
    paused = value.endswith(R.PAUSED_SUFFIX) & value.rlike(_EVENT + r"Server now has \d+ paused threads\.")
    pressure = value.contains(R.PRESSURE_TEXT) & value.rlike(_EVENT + r"Server under resource pressure\.  Pause rate CPU \d+%, mem \d+%, CPU pressure \d+, mem pressure \d+")
    return active | paused | pressure


def is_block_end(value: Column) -> Column:
    return (F.length(value) == 0) | value.isin(*R.HEADERS) | is_ignored(value) | is_event(value)


def block_type(first: Column) -> Column:
    return (
        F.when(F.length(first) == 0, "blank").when(first.startswith(R.HEADERS[0]), "info").when(first.endswith(R.ACTIVE_SUFFIX), "active")
        .when(first.endswith(R.PAUSED_SUFFIX), "paused").when(first.contains(R.PRESSURE_TEXT), "pressure").otherwise("error")
    )


def frame(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, btype, lines array<binary>) of lines (log_id, line_no, value).

    ``line_no`` is that of the block's first line, the header; ``lines`` are those after it, for events the line
    itself. Ignored lines end a block and belong to none; blocks of blank lines only are left out.
    """
    value = F.col("value")
    marked = lines.where(value.isNotNull()).withColumn("_end", is_block_end(value))
    # A line that is no block end but follows one that opens nothing starts a block of its own, under the end's number.
    marked = carried(marked, F.when(F.col("_end"), F.col("line_no")), "line_no", "log_id", RUN_LINES, "block")
    kept = marked.where(~is_ignored(value)).withColumn("block", F.coalesce("block", F.lit(0).cast("bigint")))
    blocks = kept.groupBy("log_id", "block").agg(F.sort_array(F.collect_list(F.struct("line_no", F.col("value").cast("binary").alias("v")))).alias("ls"))
    # A blank line opens a block only in name (and number): the first line with text decides.
    blank = F.octet_length(F.col("ls")[0]["v"]) == 0
    text = F.when(blank, F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0)))).otherwise(F.col("ls"))
    blocks = blocks.select("log_id", F.col("ls")[0]["line_no"].alias("line_no"), text.alias("ls")).where(F.size("ls") > 0)
    blocks = blocks.withColumn("btype", block_type(F.col("ls")[0]["v"].cast("string")))
    body = F.when(F.col("btype").isin("active", "paused", "pressure"), F.col("ls")).otherwise(F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0))))
    return blocks.select("log_id", "line_no", "btype", F.transform(body, lambda s: s["v"]).alias("lines")).where(F.size("lines") > 0)


class Framer:
    """Blocks of one log's lines as they come: (line number, type, lines)."""

    def __init__(self):
        self.block: tuple[int, list[str]] | None = None
        self.kind = "blank"

    def feed(self, line_no: int, line: str) -> tuple[int, str, list[str]] | None:
        """Takes a line; returns the block that it ends, if that has lines."""
        done = self.close() if R.is_block_end(line) else None
        if line.startswith(R.IGNORED_PREFIXES):
            return done
        if self.block is None:
            self.block, self.kind = (line_no, []), "blank"
        if self.kind == "blank":
            self.kind = R.block_type(line)
            if self.kind in ("active", "paused", "pressure"):
                self.block[1].append(line)
        else:
            self.block[1].append(line)
        return done

    def close(self) -> tuple[int, str, list[str]] | None:
        block, self.block = self.block, None
        return (block[0], self.kind, block[1]) if block and block[1] else None

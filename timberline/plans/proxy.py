"""Proxy logs: completed records with transfer totals, block by block without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalars import byte_size, parse_time, to_single
from timberline.sources.logs import carried

HEADERS = ("Perforce proxy info:", "Perforce proxy error:")

_SECONDS = r"([0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)s"
_COMPLETED = rf"(?d)^\t(\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d) pid (\d+) completed {_SECONDS}"
_TOTALS = r"(?d)^--- proxytotals files/size svr\+cache (\d+)\+(\d+)/([0-9.]+[BKMGTP])\+([0-9.]+[BKMGTP])"


def parse_proxy(lines: DataFrame) -> DataFrame:
    """(log_id, lineNumber, pid, endTime, completedLapse, proxyTotals...) of lines (log_id, line_no, value).

    A block gives a row if it has a completed record (the last counts) followed by tracking; the tracked lapse
    overrides that of the record.
    """
    value = F.col("value")
    ends = (F.length(value) == 0) | value.isin(*HEADERS)
    marked = carried(lines.where(value.isNotNull()), F.when(ends, F.col("line_no")), "line_no", "log_id", 100_000, "block").where(F.col("block").isNotNull())
    info = F.max(F.when((F.col("line_no") == F.col("block")) & (value == HEADERS[0]), True))
    part = lambda pattern, i: F.regexp_extract(value, pattern, i)
    done = value.rlike(_COMPLETED)
    last = lambda cond, *cols: F.max_by(F.struct(*cols), F.when(cond, F.col("line_no")))
    blocks = marked.groupBy("log_id", "block").agg(
        info.alias("info"),
        F.max(F.when(done, F.col("line_no"))).alias("done_at"), F.max(F.when(value.startswith("---"), F.col("line_no"))).alias("track_at"),
        last(done, part(_COMPLETED, 1).alias("t"), part(_COMPLETED, 2).alias("pid"), part(_COMPLETED, 3).alias("s")).alias("done"),
        last(value.startswith("--- lapse "), part(rf"^--- lapse {_SECONDS}", 1).alias("s")).alias("lapse"),
        last(value.rlike(_TOTALS), *(part(_TOTALS, i).alias(f"v{i}") for i in range(1, 5))).alias("totals"),
    )
    blocks = blocks.where(F.col("info") & (F.col("track_at") > F.col("done_at")))
    number = lambda i: F.coalesce(F.col(f"totals.v{i}").try_cast("bigint"), F.lit(0))
    size = lambda i: F.coalesce(byte_size(F.col(f"totals.v{i}")), F.lit(0))
    return blocks.select(
        "log_id", F.col("block").alias("lineNumber"), F.col("done.pid").cast("bigint").alias("pid"), parse_time(F.col("done.t")).alias("endTime"),
        to_single(F.coalesce("lapse.s", "done.s")).alias("completedLapse"), number(1).alias("proxyTotalsSvr"), number(2).alias("proxyTotalsCache"), size(3).alias("proxyTotalsSvrBytes"), size(4).alias("proxyTotalsCacheBytes"),
    )

"""Log files as lines (log_id, line_no, value), with line numbers that run on over all files of a log."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a line that the loader keeps; the lock and pending reports keep twice as many.
MAX_LINE = 5000
#: Bytes of the longest line that is read; a longer one stops the load with an error.
LONGEST_LINE = 5 << 20


def cut_long(value, max_line: int = MAX_LINE):
    """Lines over ``max_line`` bytes end in ``...'`` after that many bytes; line ends are trimmed first, bytes stay as they are.

    A line over ``LONGEST_LINE`` bytes is an error, as it is no log line.
    """
    value = F.rtrim(value, F.lit("\r\n"))
    raw = F.concat(F.substring(value.cast("binary"), 1, max_line), F.lit("...'").cast("binary"))
    size = F.octet_length(value)
    error = F.raise_error(F.concat(F.lit(f"a line is over {LONGEST_LINE} bytes: "), size.cast("string"))).cast("string")
    return F.when(size > LONGEST_LINE, error).when(size > max_line, raw.cast("string")).otherwise(value)


def read_lines(spark: SparkSession, paths: list[str], log_id: str = "log", max_line: int = MAX_LINE) -> DataFrame:
    """Lines of text files (``.gz`` too) in the order of ``paths``.

    A line's number is its number within its file split plus the lines of all splits before; only one count for
    each split goes through the driver.
    """
    order = {p: i for i, p in enumerate(paths)}
    parts = []
    for path, seq in order.items():
        df = spark.read.option("lineSep", "\n").text(path).select(F.lit(seq).alias("seq"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("m"), "value")
        parts.append(df)
    rows = parts[0]
    for df in parts[1:]:
        rows = rows.unionByName(df)
    split = ["seq", "file_path", "file_block_start"]
    sizes = rows.groupBy(*split).agg(F.count("*").alias("n"), F.min("m").alias("first")).orderBy(*split).collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["seq"], r["file_path"], r["file_block_start"], before - r["first"]))
        before += r["n"]
    shift = spark.createDataFrame(offsets, "seq int, file_path string, file_block_start bigint, shift bigint")
    joined = rows.join(shift, split)
    return joined.select(F.lit(log_id).alias("log_id"), (F.col("m") + F.col("shift") + 1).alias("line_no"), cut_long(F.col("value"), max_line).alias("value"))


def read_gzip_by_content(spark: SparkSession, paths: list[str], log_id: str = "log", max_line: int = MAX_LINE) -> DataFrame:
    """As ``read_lines`` for files that may be gzip without saying so in their names; each file is one stream of one task.

    A task holds the file's bytes as they are, never what they inflate to. Files count by their whole paths.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    order: dict[str, int] = {}
    for i, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        order.setdefault(path.getFileSystem(conf).makeQualified(path).toUri().getPath(), i)
    files = spark.read.format("binaryFile").load(paths).select(F.col("path"), "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                seq = order[unquote(urlsplit(batch.column(0)[r].as_py()).path)]
                stream = io.BytesIO(memoryview(batch.column(1)[r].as_buffer()))
                if stream.read(2) == b"\x1f\x8b":
                    stream.seek(0)
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                else:
                    stream.seek(0)
                at = 0
                while part := [line.removesuffix(b"\n") for line in islice(stream, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array([seq] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.binary())], ["seq", "n", "raw"])
                    at += len(part)

    lines = files.mapInArrow(rows, "seq int, n bigint, raw binary")
    counts = lines.groupBy("seq").agg(F.count("*").alias("n")).orderBy("seq").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["seq"], before))
        before += r["n"]
    shift = spark.createDataFrame(offsets, "seq int, before bigint")
    return lines.join(shift, "seq").select(F.lit(log_id).alias("log_id"), (F.col("n") + F.col("before") + 1).alias("line_no"), cut_long(F.col("raw").cast("string"), max_line).alias("value"))


def lines_of_text(spark: SparkSession, text: str, log_id: str = "log") -> DataFrame:
    """Lines of a string; for tests and small inputs."""
    rows = [(log_id, i, line.encode("utf-8", "surrogateescape")) for i, line in enumerate(text.split("\n"), 1)]
    df = spark.createDataFrame(rows, "log_id string, line_no bigint, raw binary")
    return df.select("log_id", "line_no", cut_long(F.col("raw").cast("string")).alias("value"))


def slice_lines(lines: DataFrame, first: int, last: int, pattern: str | None = None) -> DataFrame:
    """Lines by number, optionally those that match a pattern."""
    out = lines.where(F.col("line_no").between(first, last))
    return out.where(F.col("value").rlike(pattern)) if pattern else out


def carried(df: DataFrame, value, order: str, by: str, chunk: int, name: str) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row of its log, without one task for a whole log.

    Within runs of ``chunk`` numbers a window carries it; between runs a window over one row for each run does.
    """
    run = F.floor(F.col(order) / chunk)
    df = df.withColumn("_run", run).withColumn("_value", value)
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(by, "_run").orderBy(order))
    ends = df.groupBy(by, "_run").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(by, "_run", before.alias("_before"))
    return df.join(ends, [by, "_run"]).withColumn(name, F.coalesce(inside, "_before")).drop("_run", "_value", "_before")

"""Shared plumbing of the training-data operators: tables, scratch storage, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, pruned to ``columns`` when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs in this one process (local tests) is a temporary folder made and
    stored there; on a cluster that raises, since executors do not share a machine's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder.

    ``keep`` writes a DataFrame as Parquet and reads it back: that cuts lineage, so a lost executor costs
    only the tasks that were running, and fixes the rows of non-deterministic steps. ``drop`` deletes
    a table that later tables no longer need. Results read their tables when they are used, so these stay until the
    caller deletes them: ``with discarding(spark)`` does it for all that was made inside it.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        for made in _WATCHED:
            made.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


_WATCHED: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables that were made inside, at its end; what is still wanted must be written elsewhere by then."""
    made: list[str] = []
    _WATCHED.append(made)
    try:
        yield
    finally:
        _WATCHED.remove(made)
        for base in made:
            _delete(spark, base)


#: Texts are long; batches of this many rows bound what the JVM and a worker hold of them at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, unless the session already asks for fewer.

    This changes the session's setting for good: plans read it when they run, which is after the call that made them.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


_OF_WORKER: dict = {}


def for_worker(key, make: Callable):
    """What this worker keeps between tasks, made on first use: one thing at a time, so that operators do not add up."""
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[key] = make()
    return _OF_WORKER[key]


def release_worker() -> None:
    """Drops what this worker keeps. (A call by name: functions that Spark ships get copies of globals.)"""
    _OF_WORKER.clear()


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str, every: int = 2000, keeps: bool = False, heavy: str | None = None) -> DataFrame:
    """``mapInArrow`` for functions that yield one dict per output row; at most ``every`` rows make a batch.

    Unless the function ``keeps`` something in its worker, what another one kept there goes first. A batch ends
    too once the values of the ``heavy`` column have HEAVY_BYTES.
    """
    small_batches(df.sparkSession)
    spark_schema = _parsed(df.sparkSession, schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release_worker()
        yield from as_batches(rows(batches), arrow, every, heavy)

    return df.mapInArrow(run, spark_schema)


def _parsed(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


#: Bytes of a batch's heavy column.
HEAVY_BYTES = 8 << 20


def as_batches(rows: Iterable[dict], schema: pa.Schema, every: int = 2000, heavy: str | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[heavy] or b"") if heavy else 0
        if len(held) >= every or size >= HEAVY_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def texts_of(batch: pa.RecordBatch, column: str, step: int = 256) -> Iterator[tuple[int, list]]:
    """The column in slices of ``step`` rows, so that only a few texts are Python objects at once."""
    data = batch.column(batch.schema.get_field_index(column))
    for at in range(0, len(data), step):
        yield at, data.slice(at, step).to_pylist()


def filter_rows(df: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[bool]]]], keeps: bool = False) -> DataFrame:
    """The rows of ``df`` that ``keep`` marks, with all their columns as they are; nothing shuffles. ``keeps`` as in ``map_arrow``."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release_worker()
        for batch, mask in keep(batches):
            yield batch if all(mask) else batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

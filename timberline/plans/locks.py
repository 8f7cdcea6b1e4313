"""Lock timeline: long waits and holds of table locks as intervals, in the server's lock order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalars import milliseconds

# The order in which the server takes table locks.
LOCK_ORDER = """
db.config db.configh db.counters db.nameval db.upgrades.rp db.upgrades db.logger db.ldap db.topology db.server db.svrview
db.remote db.rmtview db.stash db.user.rp db.user db.ticket.rp db.ticket db.group db.groupx db.depot db.stream
db.streamrelation db.streamview db.streamviewx db.streamq db.integedss db.domain db.template db.templatesx db.templatewx
db.view.rp db.view db.haveview db.review db.label db.have.rp db.have.pt db.have db.integed db.integtx db.resolve
db.resolvex db.resolveg db.scandir db.scanctl db.storagesh db.storage db.storageg db.storagesx db.storageup_R
db.storageup_W db.storagemasterup_R db.storagemasterup_W db.revdx db.revhx db.revpx db.revsx db.revsh db.revbx db.revux
db.revcx db.rev db.revtx db.revstg db.revfs db.locks db.locksg db.working db.workingx db.workingg db.haveg db.excl
db.exclg db.exclgx db.traits db.trigger db.change db.changex db.changeidx db.desc db.repo db.refhist db.ref
db.refcntadjust db.object db.graphindex db.graphperm db.submodule db.pubkey db.job db.fix db.fixrev db.bodresolve
db.bodresolvex db.bodtext db.bodtextcx db.bodtexthx db.bodtextsx db.bodtextwx db.ixtext db.ixtexthx db.uxtext db.protect
db.property db.message db.sendq db.sendq.pt db.jnlack db.monitor
""".split()


def lock_records(process: DataFrame, table_use: DataFrame, threshold_ms: int = 10_000, exclude: str = "") -> DataFrame:
    """A row per command, table and side (read or write) that waited for or held a lock longer than the threshold.

    ``exclude`` is a pattern on bare table names. Times in milliseconds; max_lock is the longer of wait and hold.
    """
    rows = table_use.drop("lineNumber").join(process, "processkey")
    if exclude:
        rows = rows.where(~F.col("tableName").rlike(f"({exclude})"))
    side = lambda name: F.struct(F.lit(name.lower()).alias("side"), F.col(f"total{name}Wait").alias("wait"), F.col(f"total{name}Held").alias("held"))
    each = rows.withColumn("l", F.explode(F.array(side("Read"), side("Write"))))
    each = each.where((F.col("l.wait") > threshold_ms) | (F.col("l.held") > threshold_ms))
    return each.select(
        F.concat(F.lit("db."), "tableName").alias("table"), "pid", "cmd", F.col("lineNumber").alias("line"), "user", F.col("startTime").alias("start"), "endTime", "workspace",
        milliseconds(F.col("computedLapse")).alias("compute_ms"), milliseconds(F.col("completedLapse")).alias("completed_ms"), "app", "running",
        (F.col("uCpu") * 1000).alias("u_cpu"), (F.col("sCpu") * 1000).alias("s_cpu"), "l.side", "l.wait", "l.held", F.greatest("l.wait", "l.held").alias("max_lock"),
    )


def lock_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(LOCK_ORDER)], "table string, place int")


def in_lock_order(records: DataFrame, threshold_ms: int = 10_000) -> DataFrame:
    """The records of tables in the lock order, with their place in it; the order's rows are a fixed few."""
    return records.where(F.col("max_lock") > threshold_ms).join(F.broadcast(lock_order(records.sparkSession)), "table").orderBy("place", "start", "line")


def intervals(records: DataFrame) -> DataFrame:
    """Two rows per record, if not empty: the wait from the start of the command, then the hold."""
    begin = F.unix_millis(F.col("start").cast("timestamp"))
    wait = F.struct(F.lit("wait").alias("what"), begin.alias("from_ms"), (begin + F.col("wait")).alias("to_ms"))
    held = F.struct(F.lit("held").alias("what"), (begin + F.col("wait")).alias("from_ms"), (begin + F.col("wait") + F.col("held")).alias("to_ms"))
    each = records.select("table", "pid", "line", "cmd", "user", "side", F.explode(F.array(wait, held)).alias("i"))
    return each.select("table", "pid", "line", "cmd", "user", "side", "i.*").where("to_ms > from_ms")


def pending(process: DataFrame) -> DataFrame:
    """Commands without an end, the latest first."""
    return process.where("endTime IS NULL").orderBy(F.col("startTime").desc(), F.col("lineNumber").desc())


def lock_counts(process: DataFrame, records: DataFrame) -> DataFrame:
    """(what, n): all commands, and the lock records found among them."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(process, "commands").unionByName(count(records, "records"))


def pending_counts(process: DataFrame, events: DataFrame) -> DataFrame:
    """(what, n): commands and server events together, and the commands without an end."""
    count = process.agg(F.count("*").alias("n"), F.count_if(F.col("endTime").isNull()).alias("open"))
    total = count.select("n").unionByName(events.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))
    return total.select(F.lit("total").alias("what"), "n").unionByName(count.select(F.lit("pending").alias("what"), F.col("open").alias("n")))

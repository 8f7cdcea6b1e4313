"""Columns of the relational tables, and the Spark schemas made from them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: Librarian kinds and counters; every pair is a column, e.g. lbrRcsOpens.
LBR_KINDS = ("Rcs", "Binary", "Compress", "Uncompress")
LBR_COUNTERS = ("Opens", "Closes", "Checkins", "Exists", "Reads", "ReadBytes", "Writes", "WriteBytes", "Digests", "FileSizes", "Modtimes", "Copies")

IDENTITY = ("user", "workspace", "ip", "app", "cmd", "args")
USAGE = ("uCpu", "sCpu", "diskIn", "diskOut", "ipcIn", "ipcOut", "maxRss", "pageFaults")
MEMORY = ("memMB", "memPeakMB")
RPC = ("rpcMsgsIn", "rpcMsgsOut", "rpcSizeIn", "rpcSizeOut", "rpcHimarkFwd", "rpcHimarkRev")
RPC_WAIT = ("rpcSnd", "rpcRcv")
FILE_TOTALS = ("fileTotalsSnd", "fileTotalsRcv", "fileTotalsSndMB", "fileTotalsRcvMB")
NET_SYNC = ("netSyncFilesAdded", "netSyncFilesUpdated", "netSyncFilesDeleted", "netSyncBytesAdded", "netSyncBytesUpdated")
LBR = tuple(f"lbr{kind}{counter}" for kind in LBR_KINDS for counter in LBR_COUNTERS)
SECONDS = ("computedLapse", "completedLapse", "paused", *RPC_WAIT)

#: All numeric columns of a command that a later record overwrites when it is above 0.
COUNTERS = (*USAGE, *MEMORY, *RPC, *FILE_TOTALS, *NET_SYNC, *LBR)

TABLE_COUNTERS = (
    *("pagesIn", "pagesOut", "pagesCached", "pagesSplitInternal", "pagesSplitLeaf"),
    *("readLocks", "writeLocks", "getRows", "posRows", "scanRows", "putRows", "delRows"),
    *("totalReadWait", "totalReadHeld", "totalWriteWait", "totalWriteHeld"),
    *("maxReadWait", "maxReadHeld", "maxWriteWait", "maxWriteHeld"),
    *("peekCount", "totalPeekWait", "totalPeekHeld", "maxPeekWait", "maxPeekHeld"),
)

PROCESS_COLUMNS = (
    *("processkey", "lineNumber", "pid", "startTime", "endTime", "computedLapse", "completedLapse", "paused"),
    *(*IDENTITY, *USAGE, *MEMORY, *RPC, *RPC_WAIT, *FILE_TOTALS, "running", *NET_SYNC, *LBR, "error"),
)
TABLE_USE_COLUMNS = ("processkey", "lineNumber", "tableName", *TABLE_COUNTERS, "triggerLapse")
EVENT_COLUMNS = ("lineNumber", "eventTime", "activeThreads", "activeThreadsMax", "pausedThreads", "pausedThreadsMax", "pausedErrorCount", "pauseRateCPU", "pauseRateMem", "cpuPressureState", "memPressureState")
PROXY_COLUMNS = ("lineNumber", "pid", "endTime", "completedLapse", "proxyTotalsSvr", "proxyTotalsCache", "proxyTotalsSvrBytes", "proxyTotalsCacheBytes")

_STRINGS = {"processkey", "tableName", *IDENTITY}
_TIMES = {"startTime", "endTime", "eventTime"}
_DOUBLES = {*SECONDS, "triggerLapse"}


def _field(name: str) -> StructField:
    kind = StringType() if name in _STRINGS else TimestampType() if name in _TIMES else DoubleType() if name in _DOUBLES else BooleanType() if name == "error" else LongType()
    return StructField(name, kind)


TABLE_STRUCT = StructType([_field(n) for n in ("tableName", *TABLE_COUNTERS, "triggerLapse")])
COMMAND_SCHEMA = StructType([*(_field(n) for n in PROCESS_COLUMNS), StructField("tables", ArrayType(TABLE_STRUCT))])
EVENT_SCHEMA = StructType([_field(n) for n in EVENT_COLUMNS])
PROXY_SCHEMA = StructType([_field(n) for n in PROXY_COLUMNS])
#: What the correlation emits: either a command or a server event, with its place in the order of output.
OUTPUT_SCHEMA = StructType([StructField("log_id", StringType()), StructField("emitted", LongType()), StructField("command", COMMAND_SCHEMA), StructField("event", EVENT_SCHEMA)])

"""Scalar expressions of the log domain; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a metric label may hold; others become ``_``.
LABEL_OTHERS = r"[^a-zA-Z0-9_/+:@{}&%<>*\\.,()\[\]-]"
_UNITS = ("K", "M", "G", "T", "P")


def to_int(text: Column) -> Column:
    """Digits as a number, anything else as 0."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


def to_single(text: Column) -> Column:
    """A number in single precision, anything else as 0."""
    return F.coalesce(text.try_cast("float"), F.lit(0).cast("float")).cast("double")


def byte_size(text: Column) -> Column:
    """``12.1K`` by powers of 1024 in single precision; ``B`` or no unit is bytes."""
    unit = F.upper(F.right(text, F.lit(1)))
    number = to_single(F.regexp_replace(text, "[BKMGTP]$", ""))
    power = F.lit(0)
    for i, u in enumerate(_UNITS, 1):
        power = F.when(unit == u, i).otherwise(power)
    return F.floor(number * F.pow(F.lit(1024.0), power)).cast("bigint")


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss"))


def plus_seconds(time: Column, lapse: Column) -> Column:
    """Later by whole seconds of the lapse."""
    return F.timestamp_add("SECOND", F.floor(lapse).cast("int"), time)


def sanitise_label(text: Column) -> Column:
    return F.regexp_replace(text, LABEL_OTHERS, "_")


def program_label(app: Column) -> Column:
    return sanitise_label(F.replace(app, F.lit(" (brokered)"), F.lit("")))


def replica_of(ip: Column) -> Column:
    """What is before the first ``/``, if anything is; else the empty string."""
    return F.when(F.instr(ip, "/") > 1, F.substring_index(ip, "/", 1)).otherwise(F.lit(""))


def client_of(ip: Column) -> Column:
    at = F.instr(ip, "/")
    return F.when(at > 1, F.substring(ip, at + F.lit(1), F.length(ip))).otherwise(ip)


def milliseconds(lapse: Column) -> Column:
    return F.floor(lapse * 1000).cast("bigint")


def byte_count_decimal(n: Column) -> Column:
    """``1.2 kB`` in powers of 1000."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate("kMGTPE", 1):
        out = F.when(n >= 1000**i, F.format_string(f"%.1f {unit}B", n / float(1000**i))).otherwise(out)
    return out


def humanise(ms: Column) -> Column:
    """``1h 02m 03s`` of milliseconds, without leading zero parts; below a second ``45ms``."""
    s = F.floor(ms / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    long = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), two(minutes), F.lit("m "), two(seconds), F.lit("s")))
    return F.when(s == 0, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.coalesce(long, F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), two(seconds), F.lit("s"))), F.concat(seconds.cast("string"), F.lit("s"))))

"""Time stamps in epoch milliseconds: guards, skew bound, conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default skew window, and the largest integers the two ends can hold.
SKEW_MS = 300_000
MAX_SAFE_MS = 2**53 - 1
MAX_LONG_MS = 2**63 - 1


def is_epoch_ms(v: Column) -> Column:
    """A whole number, not negative. Takes any numeric or decimal column."""
    d = v.cast("double")
    return v.isNotNull() & (d >= 0) & (d == F.floor(d))


def is_safe_ms(v: Column) -> Column:
    return is_epoch_ms(v) & (v.cast("decimal(38,0)") <= F.lit(MAX_SAFE_MS).cast("decimal(38,0)"))


def is_long_ms(v: Column) -> Column:
    return is_epoch_ms(v) & (v.cast("decimal(38,0)") <= F.lit(MAX_LONG_MS).cast("decimal(38,0)"))


def to_safe_ms(v: Column) -> Column:
    """The value as a long, or an error that names the overflow."""
    return F.when(is_safe_ms(v), v.cast("long")).otherwise(F.raise_error(F.concat(F.lit("ERR_TS_OVERFLOW: "), v.cast("string"))).cast("long"))


def skew_bound(a: Column, b: Column, skew_ms: int = SKEW_MS) -> Column:
    """The time from which on remote changes must be looked at again."""
    return F.greatest(F.lit(0).cast("long"), F.least(a, b) - F.lit(skew_ms))


def iso_to_ms(iso: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(iso))


def file_stamp(ms: Column) -> Column:
    """ISO time with ``:`` and ``.`` as ``-``, for file names."""
    return F.regexp_replace(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[:.]", "-")

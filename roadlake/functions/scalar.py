"""Small column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null for 0 / 0 and x / 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def valid_confidence(c: Column) -> Column:
    """Within [0, 1]; false for null and NaN (which sorts above every number)."""
    return F.coalesce(c.between(0.0, 1.0) & ~F.isnan(c), F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The nearest value in range; null and NaN become null."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def checksum(c: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(c.cast("string"), 256)


def to_utc(local: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(local, zone)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, with or without a time zone (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

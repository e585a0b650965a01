"""Timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_MICROS = {"seconds": 1_000_000, "milliseconds": 1_000, "microseconds": 1}
#: Microseconds of the years 1 to 9999: epoch values beyond them cannot be read.
_FIRST_MICROS, _LAST_MICROS = -62_135_596_800_000_000, 253_402_300_799_999_999


def _epoch(number: Column, factor: int) -> Column:
    """An epoch value as a timestamp; null if it is out of range or not a number."""
    # NaN is larger than every number, so it is out of range
    inside = number.between(F.lit(-(-_FIRST_MICROS // factor)), F.lit(_LAST_MICROS // factor))
    return F.when(inside, F.timestamp_micros((number * F.lit(factor)).cast("bigint")))


def to_utc(
    name: str, data_type: T.DataType, unit: str = "seconds", pattern: str | None = None
) -> Column:
    """Any timestamp representation as a UTC TIMESTAMP; a cell that cannot be read becomes null.

    ``pattern`` declares what text cells hold: ``epoch`` for numbers, ``text`` for dates in Spark's
    own notation, or a date pattern such as ``yyyyMMdd``.  Without it each cell decides: a number is
    an epoch value, anything else is parsed.
    """
    if unit not in _EPOCH_MICROS:
        raise ValueError(f"unknown timestamp unit: {unit}")
    cell = F.col(name)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return cell.cast("timestamp")
    factor = _EPOCH_MICROS[unit]
    if isinstance(data_type, T.IntegralType):
        return _epoch(cell.cast("bigint"), factor)
    if isinstance(data_type, T.NumericType):
        return _epoch(cell, factor)
    number = cell.try_cast("bigint")
    fraction = cell.try_cast("double")
    epoch = F.coalesce(
        _epoch(number, factor), F.when(number.isNull(), _epoch(fraction, factor))
    )
    if pattern is None:
        return F.coalesce(epoch, F.when(fraction.isNull(), F.try_to_timestamp(cell)))
    if pattern == "epoch":
        return epoch
    if pattern == "text":
        return F.try_to_timestamp(cell)
    return F.try_to_timestamp(cell, F.lit(pattern))


def weekday_of(ts: Column) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(ts)


def slot_of(ts: Column, slot_seconds: int) -> Column:
    """Number of the time-of-day slot."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.floor(seconds / F.lit(slot_seconds)).cast("int")

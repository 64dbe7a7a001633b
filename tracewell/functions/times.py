"""ISO-8601 text and epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date and time of day, fraction optional, zone optional (no zone reads as UTC).
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def iso_timestamp(text: Column) -> Column:
    """Timestamp of ISO text with ``Z`` or an offset; null if it is not such text."""
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds of ISO text; empty text is 0, other text that does not parse is null."""
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.unix_millis(iso_timestamp(text)))


def millis_iso(millis: Column) -> Column:
    """UTC text with milliseconds, ``2026-01-01T00:00:00.000Z``."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros(timestamp: Column) -> Column:
    """Epoch microseconds; also accepts timestamps without a zone (the session zone must be UTC)."""
    return F.unix_micros(timestamp.cast("timestamp"))


def isoformat(timestamp: Column) -> Column:
    """UTC text with an offset and, only where there is one, a six-digit fraction."""
    plain = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(timestamp, ".SSSSSS")
    has_fraction = F.pmod(F.unix_micros(timestamp), F.lit(1_000_000)) != 0
    return F.concat(plain, F.when(has_fraction, fraction).otherwise(""), F.lit("+00:00"))

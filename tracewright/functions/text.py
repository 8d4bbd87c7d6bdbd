"""Column functions on names, descriptions and time texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewright import constants as C


def clean_channel(name: Column) -> Column:
    """Drop every ``EEG `` and trim."""
    return F.trim(F.replace(name, F.lit("EEG "), F.lit("")))


def strip_note(description: Column) -> Column:
    """Drop one leading note prefix, then trim."""
    rest = F.substr(description, F.lit(len(C.NOTE_PREFIX) + 1))
    return F.trim(F.when(F.startswith(description, F.lit(C.NOTE_PREFIX)), rest).otherwise(description))


def mark_label(description: Column) -> Column:
    """Positive mark -> 1, negative mark -> 0, anything else null. Exact match:
    strip the note first if the source writes one."""
    return (F.when(description == C.POSITIVE_MARK, F.lit(1))
            .when(description == C.NEGATIVE_MARK, F.lit(0)))


def patient_number(file_name: Column) -> Column:
    """Number after a leading upper-case ``P``; null when the name has none."""
    digits = F.regexp_extract(file_name, r"^P(\d+)_", 1)
    return F.when(digits != "", digits).cast("int")


def patient_id(file_name: Column) -> Column:
    """Upper-cased patient id, any letter case accepted; null when absent."""
    pid = F.upper(F.regexp_extract(file_name, r"(?i)^(P\d+)_", 1))
    return F.when(pid != "", pid)


def _time_text(ms: Column) -> Column:
    part = lambda divisor, base: (F.floor(ms / F.lit(divisor)) % base).cast("bigint")
    hours = F.floor(ms / F.lit(3_600_000)).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", hours, part(60_000, 60),
                           part(1_000, 60), (ms % 1_000).cast("bigint"))


def time_text(sec: Column) -> Column:
    """``hh:mm:ss.mmm`` rounded half-to-even to the millisecond; hours unbounded."""
    return _time_text(F.bround(sec * 1000.0).cast("bigint"))


def time_text_truncated(sec: Column) -> Column:
    """``hh:mm:ss.mmm`` with the milliseconds cut off instead of rounded."""
    whole = F.floor(sec)
    millis = F.floor((sec - whole) * 1000.0)
    return _time_text((whole * 1000 + millis).cast("bigint"))

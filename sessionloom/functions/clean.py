"""Cleaning expressions: every cast yields NULL on bad input, also under ANSI mode."""

from pyspark.sql import Column, functions as F


def blank_to_null(c: Column) -> Column:
    """Trim; an empty or blank string becomes NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def digits_to_double(c: Column) -> Column:
    """Drop everything but digits and dots, then read a double (``R$ 900`` -> 900.0)."""
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("double")


def whole_number(c: Column, to: str = "int") -> Column:
    """Integer part of a decimal string; other text and overflow give NULL."""
    text = F.trim(c)
    whole = F.regexp_extract(text, r"^([+-]?\d+)(\.\d*)?$", 1)
    return F.when(text.rlike(r"^[+-]?\.\d+$"), F.lit("0")).otherwise(whole).try_cast(to)


def epoch_ms_to_timestamp(c: Column) -> Column:
    """Epoch milliseconds held as a string -> timestamp, milliseconds kept."""
    return F.timestamp_millis(whole_number(c, "bigint"))


def present(columns, wanted) -> list[str]:
    """The ``wanted`` names that exist, so optional columns may be missing."""
    have = set(columns)
    return [c for c in wanted if c in have]

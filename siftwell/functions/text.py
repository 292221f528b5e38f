"""Strings: trimming, cleaning, hashing, bounded lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ADDRESS_EDGES


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes off U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_address(c: Column) -> Column:
    return F.lower(F.btrim(strip(c), F.lit(ADDRESS_EDGES)))


def normalise_address(c: Column) -> Column:
    return F.lower(strip(c))


def stable_hash(c: Column) -> Column:
    """SHA-256 in hexadecimal of the text, stripped and in lower case: of addresses, domains and contents."""
    return F.sha2(F.lower(strip(c)), 256)


def sanitise(c: Column, most: int = 500) -> Column:
    """NULs go before white space is stripped."""
    return F.left(strip(F.replace(c, F.lit("\0"), F.lit(""))), F.lit(most))


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0))


def truthy(new: Column, old: Column) -> Column:
    """A field is overwritten only by a value that is there and not empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def joined_notes(notes: Column) -> Column:
    return F.nullif(F.array_join(notes, "; "), F.lit(""))


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def file_stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")

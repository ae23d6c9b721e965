"""Truncated SHA-256 masking of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_LENGTH = 16


def mask_sha256(col: Column, length: int = MASK_LENGTH) -> Column:
    """First ``length`` hex characters of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(col.cast("string"), 256), 1, length)


def is_masked(col: Column, length: int = MASK_LENGTH) -> Column:
    """Format check: exactly ``length`` lower-case hex characters."""
    return col.rlike(f"^[0-9a-f]{{{length}}}$")

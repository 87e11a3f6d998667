"""Canonical forms of identifiers that arrive in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = r"^[0-9a-f]{32}\z"


def stripped(text: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def canonical_guid(text: Column) -> Column:
    """The 32 hex digits in lower case, however written; other text stripped, in lower case. Null stays null."""
    low = F.lower(text)
    digits = F.regexp_replace(low, r"(?U)[\s{}()\-]", "")
    return F.when(low.rlike(_HEX), low).when(digits.rlike(_HEX), digits).otherwise(stripped(low))


def is_guid(canonical: Column) -> Column:
    return canonical.rlike(_HEX)


def simple_name(key: Column) -> Column:
    """What follows the last dot or ``::``, in lower case without surrounding blanks."""
    return F.lower(stripped(F.regexp_replace(key, r"(?s)^.*(\.|::)", "")))

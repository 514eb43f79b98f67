"""Identifier clean-up shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space, for Java's and Python's regular expressions alike.
_CODES = (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
SPACE = r"\s" + "".join(map(chr, _CODES))
_CHARACTERS = " \t\n\x0b\f\r" + "".join(map(chr, _CODES))


def strip_space(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(_CHARACTERS))


def clean_id(c: Column | str) -> Column:
    """The trimmed id, or null where it is null or blank."""
    return F.nullif(strip_space(c), F.lit(""))


def squash_space(c: Column | str) -> Column:
    """Runs of white space become one space, and the ends are trimmed."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, f"[{SPACE}]+", " "))


def clean_ids(c: Column | str) -> Column:
    """An array of trimmed ids in their order, null and blank ones left out; null gives the empty array."""
    a = F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))
    return F.filter(F.transform(a, clean_id), lambda x: x.isNotNull())

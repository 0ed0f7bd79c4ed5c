"""String helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python treats as whitespace; all of them lie below U+3001.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# The same set as a character class that Java and RE2 both accept.
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Unicode-aware strip on both sides (plain ``trim`` cuts only U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE))


def whitespace_tokens(text: Column) -> Column:
    text = strip(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(text, WHITESPACE_CLASS + "+")
    )


def with_prefix(text: Column, prefix: str) -> Column:
    """``prefix`` and one space in front of the text, then strip."""
    return strip(F.concat(F.lit(prefix + " "), text))


def without_prefix(text: Column, prefix: str) -> Column:
    """All occurrences of ``prefix`` (taken literally) removed, then strip."""
    return strip(F.replace(text, F.lit(prefix), F.lit("")) if prefix else text)

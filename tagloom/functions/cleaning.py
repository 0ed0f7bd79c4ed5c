"""Removal of tags and of characters outside the corpus alphabet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cut, and runs of anything but 가-힣, a-z, A-Z, 0-9, '.', '%' and '~'. The
# second class names the other characters one range after another: Java takes four times as long
# for the negated form.
TAG_TAIL_REGEX = r":[^>\n]*+>"
OTHER_CHARS_REGEX = r"[\x00-$&-\-/:-@\[-`{-}\x7f-\x{abff}\x{d7a4}-\x{10ffff}]+"
COLLAPSED_MARKS = ("~", "%")


def clean_sentence(sentence: Column, collapse_marks: bool = True) -> Column:
    """Text without tags: tag tails and '<' deleted, every run of other characters one space.

    A tail runs from any ':' to the next '>', so text between a stray colon and a tag is lost too.
    ``collapse_marks`` also turns repeated '~' and '%' into one.
    """
    text = F.regexp_replace(sentence, TAG_TAIL_REGEX, "")
    text = F.replace(text, F.lit("<"), F.lit(""))
    text = F.trim(F.regexp_replace(text, OTHER_CHARS_REGEX, " "))
    if collapse_marks:
        # No '<' or '>' is left, so a mark can stand as '<>' while what lies between two of them goes.
        for mark in COLLAPSED_MARKS:
            for old, new in ((mark, "<>"), ("><", ""), ("<>", mark)):
                text = F.replace(text, F.lit(old), F.lit(new))
    return text

"""String expressions over one text column. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe.constants import CLEANING_STEPS, PUNCTUATION

_HTML_TAG = CLEANING_STEPS[0][0]


def clean(text: Column) -> Column:
    """Lowercase, drop markup, mentions, numbers and URL heads, collapse runs, trim."""
    replaced = reduce(
        lambda c, step: F.regexp_replace(c, step[0], step[1]), CLEANING_STEPS, F.lower(text)
    )
    return F.trim(replaced)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, _HTML_TAG, "")


def strip_punct(text: Column) -> Column:
    """Drop the 32 ASCII punctuation characters."""
    return F.translate(text, PUNCTUATION, "")


def split_on(text: Column, separator: str) -> Column:
    """Split on a literal separator, keeping empty pieces."""
    return F.split(text, f"\\Q{separator}\\E" if len(separator) > 1 else f"[{separator}]")


def piece_count(text: Column, separator: str) -> Column:
    """Number of pieces a split on a one-character separator would give."""
    without = F.replace(text, F.lit(separator), F.lit(""))
    return F.length(text) - F.length(without) + 1

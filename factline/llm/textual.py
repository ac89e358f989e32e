"""Words and lines of a text as the operators of this subpackage count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; ``bytes.split`` parts at exactly those six characters.

    A lone surrogate, which no UTF-8 text holds, becomes ``?`` instead of an error.
    """
    return encoded(text).split()


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def word_count(text: Column) -> Column:
    """Number of words as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

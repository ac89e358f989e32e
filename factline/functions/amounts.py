"""Amounts, numbers and dates as registers and statements spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words and their factor to whole dollars.
UNIT_SCALE = {"$": 1, "$m": 1_000_000, "$b": 1_000_000_000, "$'000": 1_000, "$000": 1_000, "units": 1}
NUMBER = r"\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?"
DATE_FORMATS = ("d MMM yyyy", "d MMMM yyyy", "d M yyyy", "yyyy M d", "d MMM yy", "d MMMM yy")
SHORT_YEAR = r"^(\d{1,2}) (\d{1,2}) (\d{2})$"
#: Two-digit years from here on lie in the last century when the month is a number; month names mean this century.
SHORT_YEAR_PIVOT = 69
DATE_TOKEN = r"\d{1,2}[\s\-/.](?:[A-Za-z]{3,9}|\d{1,2})[\s\-/.]\d{2,4}"
AS_AT = r"(?i)as\s+at\s+(?:close\s+of\s+business\s+)?(" + DATE_TOKEN + ")"
NO_AMOUNT = ("", "nan", "none", "-", "total")


def scale_amount(value: Column, unit: Column) -> Column:
    """To whole dollars, exactly once; an unknown unit gives null."""
    factor = F.try_element_at(F.create_map(*[x for k, v in UNIT_SCALE.items() for x in (F.lit(k), F.lit(float(v)))]), unit)
    return value * factor


def parse_number(token: Column) -> Column:
    """``(1,234.5)`` is negative; commas and currency signs are dropped."""
    plain = F.regexp_replace(token, r"[^0-9.\-]", "")
    value = plain.try_cast("double")
    return F.when(F.trim(token).rlike(r"^\(.*\)$"), -value).otherwise(value)


def register_amount(raw: Column) -> Column:
    """Everything but digits, dot and minus is noise."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^0-9.\-]", "").try_cast("double")


def parse_amount(raw: Column) -> Column:
    """Absolute dollars of a messy cell.

    A billion or million suffix scales; a bare number below half a million is a sheet in millions.
    """
    s = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    plain = F.replace(s, F.lit(","), F.lit(""))
    num = F.nullif(F.regexp_extract(plain, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    suffix = F.lower(F.regexp_extract(plain, r"(?i)\d\s*(bn|billion|b|million|mn|m)\b", 1))
    scaled = (
        F.when(suffix.startswith("b"), num * 1e9)
        .when(suffix.startswith("m"), num * 1e6)
        .when(F.abs(num) < 500_000, num * 1e6)
        .otherwise(num)
    )
    return F.when(~F.lower(s).isin(*NO_AMOUNT), F.abs(scaled))


def parse_date(raw: Column) -> Column:
    """Day-first dates with any separator; else null.

    A two-digit year lies in this century after a month's name; after a month's number, 69 to 99 lie in the last one.
    """
    token = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\-/.]", " "), r"\s+", " "))
    year = F.regexp_extract(token, SHORT_YEAR, 3).try_cast("int")
    full = F.concat(F.regexp_replace(token, r"\d{2}$", ""), (year + F.when(year >= SHORT_YEAR_PIVOT, 1900).otherwise(2000)).cast("string"))
    token = F.when(token.rlike(SHORT_YEAR), full).otherwise(token)
    return F.coalesce(*[F.try_to_timestamp(token, F.lit(fmt)) for fmt in DATE_FORMATS]).cast("date")


def as_at_date(text: Column, default: Column) -> Column:
    """Date after "as at", or of an ``as_at_note`` line among the first three; never a maturity."""
    head = F.regexp_extract(text, r"(?i)^(?:[^\n]*\n){0,2}as_at_note[^\n]*?(" + DATE_TOKEN + ")", 1)
    return F.coalesce(parse_date(F.regexp_extract(text, AS_AT, 1)), parse_date(head), default)


# A group of thousands that a blank has split, before or after its first digits.
SPLIT_GROUP = r"(?<=\d),(\d{1,2})\s+(?=\d{2,3}(?:\D|$))"
SPLIT_COMMA = r"(?<=\d),\s+(?=\d{3}(?:\D|$))"


def repair_thousands(text: Column) -> Column:
    """``54,9 53`` -> ``54,953`` and ``2, 374`` -> ``2,374``, until nothing more joins.

    Each round that changes a text takes at least one blank out of a number, so as many rounds as there are blanks before digits
    reach the fixed point; texts without a split number have none.
    """
    def one(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, SPLIT_GROUP, ",$1"), SPLIT_COMMA, ",")

    rounds = F.regexp_count(text, F.lit(r"\s\d"))
    repaired = F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), text, lambda t, _: one(t))
    return F.when(text.rlike(SPLIT_GROUP) | text.rlike(SPLIT_COMMA), repaired).otherwise(text)


def numbers(text: Column) -> Column:
    """Number tokens of a line as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), parse_number)

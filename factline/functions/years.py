"""Australian financial years (July to June) and the tokens that spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dash forms that separate the two years of a financial-year token.
DASHES = "-‐‑‒–—­/"
FY_TOKEN = r"(20\d{2}\s*[–\-­/]\s*(?:\d{2}|20\d{2}))"
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
# Reporting months in financial-year order.
FY_MONTHS = MONTHS[6:] + MONTHS[:6]


def fy_label(start: Column) -> Column:
    """``2015`` -> ``2015-16``."""
    start = start.cast("int")
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def fy_of_date(d: Column) -> Column:
    return fy_label(F.year(d) - F.when(F.month(d) >= 7, 0).otherwise(1))


def fy_start(fy: Column) -> Column:
    return F.regexp_extract(fy, r"^(\d{4})-", 1).try_cast("int")


def fy_from_label(text: Column) -> Column:
    """Financial year named by a label: a span, a June quarter, or a bare closing year."""
    span = F.regexp_extract(text, r"((?:19|20)\d{2})\s*[-–/_]\s*(?:(?:19|20)?\d{2})(?!\d)", 1)
    june = F.regexp_extract(text, r"(?i)\bjun(?:e)?(?:\s+quarter)?[\s-]*((?:19|20)\d{2})\b", 1)
    bare = F.regexp_extract(text, r"^\s*((?:19|20)\d{2})(?:\.0)?\s*$", 1)
    return F.coalesce(
        fy_label(F.nullif(span, F.lit("")).cast("int")),
        fy_label(F.nullif(june, F.lit("")).cast("int") - 1),
        fy_label(F.nullif(bare, F.lit("")).cast("int") - 1),
    )


def normalise_fy_token(raw: Column) -> Column:
    """One hyphen, two-digit closing year; text that holds no two numbers only loses its blanks."""
    plain = F.translate(raw, "–­", "--")
    digits = F.regexp_extract_all(plain, F.lit(r"(\d+)"), 1)
    first, second = F.get(digits, F.lit(0)), F.get(digits, F.lit(1))
    two = F.when(F.length(second) == 2, second).when(F.length(second) == 4, F.substring(second, 3, 2))
    return F.when((F.length(first) == 4) & two.isNotNull(), F.concat(first, F.lit("-"), two)).otherwise(
        F.regexp_replace(plain, r"\s+", "")
    )


def month_number(name: Column) -> Column:
    """1..12 for an English month name, null for anything else."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.nullif(at, F.lit(0)).cast("int")


def period_end(fy: Column, month_name: Column) -> Column:
    """Last day of a reporting month inside a financial year."""
    m = month_number(month_name)
    year = fy_start(fy) + F.when(m >= 7, 0).otherwise(1)
    return F.last_day(F.make_date(year, m, F.lit(1)))


def period_start(fy: Column, kind: Column) -> Column:
    """1 July for flows; stocks have no start."""
    return F.when(~kind.isin("stock", "stock_balance"), F.make_date(fy_start(fy), F.lit(7), F.lit(1)))


def elapsed_months(month_name: Column) -> Column:
    """July is 1, June is 12."""
    at = F.array_position(F.array(*[F.lit(m) for m in FY_MONTHS]), month_name)
    return F.nullif(at, F.lit(0)).cast("int")


def expand_two_digit_years(tokens: Column) -> Column:
    """``[1986-87, 87-88, 99-00, 00-01]`` -> four-digit starts; the century rolls forward.

    Tokens before the first four-digit start have no known century and become null.
    """

    def step(acc: Column, tok: Column) -> Column:
        head = F.regexp_extract(tok, r"^(\d+)", 1)
        prev = acc["prev"]
        base = (F.floor(prev / 100) * 100).cast("int") + head.try_cast("int")
        rolled = F.when(base < prev, base + 100).otherwise(base)
        year = F.when(F.length(head) == 4, head.try_cast("int")).otherwise(rolled)
        return F.struct(
            F.coalesce(year, prev).cast("int").alias("prev"),
            F.concat(acc["out"], F.array(fy_label(year))).alias("out"),
        )

    start = F.struct(F.lit(None).cast("int").alias("prev"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(tokens, start, step, lambda acc: acc["out"])

"""Labels: cleaning, segments, and the quality class that decides whether one may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and vocabulary of the label classes.
YEAR_TOKEN = r"\b(?:19|20)\d{2}[\-‐‑‒–—­/](?:\d{2})\b"
VALUE_TOKEN = r"-?\(?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(\d+(?:\.\d+)?\)"
UNIT_TOKEN = r"(?i)\$'?\s?000\b|\$m\b|\$b\b|\('000\)|\(\$'000\)|^000$"
BARE_NUMERIC_RUN = r"(?<![\d.])-?\d{1,4}(?:\s+-?\d{1,4}){2,}(?![\d.])"
ACCOUNTING_HEADINGS = (
    r"(?i)\b(EXPENSES|ASSETS|LIABILITIES|REVENUE|EQUITY|CASH FLOW|OPERATING ACTIVITIES|INVESTING ACTIVITIES|"
    r"FINANCING ACTIVITIES|ADMINISTERED ON BEHALF OF GOVERNMENT|COMPREHENSIVE INCOME|OWN-SOURCE INCOME|"
    r"NON-TAXATION REVENUE)\b"
)
LINE_ITEMS = (
    "employee benefits", "suppliers", "depreciation and amortisation", "depreciation/amortisation expenses",
    "finance costs", "write-down and impairment of assets", "grants", "subsidies", "personal benefits",
    "foreign exchange losses", "losses from asset sales", "other expenses", "interest", "dividends",
    "sales of goods and rendering of services", "sale of goods and rendering of services", "other revenue",
    "cash and cash equivalents", "receivables", "investments", "land, buildings and infrastructure",
    "property, plant and equipment", "computer software", "intangibles", "payables", "provisions",
    "employee provisions", "interest bearing liabilities", "contributed equity", "reserves", "retained earnings",
    "accumulated deficit", "trade creditors", "other payables", "prepayments", "inventories",
    "grants and subsidies", "goods and services", "accrued expenses",
)
TOTAL_SUBTOTAL = (
    r"(?i)^(?:Total|Sub-?total|Departmental Total|Administered Total|Net cash|Net assets|Net increase|Net decrease|"
    r"Net \(cost|Net cost|Estimated (?:opening|closing) balance|Closing balance|Opening balance)\b"
)
NARRATIVE_LEAD = r"(?i)^(?:plus|less|note|prepared on)\s*:?\s"
ACT_CITATION = r"^[A-Z][A-Za-z0-9 '()\-,.]+\bAct\s+\d{4}(?:,\s*s\.?\s*\d+[A-Za-z()0-9]*)?\s*$"
OUTCOME_NUMBER = r"(?i)(?:^|\s)Outcome\s+\d{1,2}\s*[:\-–—]"
PROGRAM_NUMBER = r"(?i)(?:^|\s)Program\s+\d{1,2}(?:\.\d{1,2})?\s*[:\-–—]"
COMPONENT_NUMBER = r"(?i)\d{1,2}\.\d{1,2}\.\d{1,2}\s*[\-–—]\s*Component"
KEY_COST = r"(?i)^Key cost category\s*/"
KEY_COST_KNOWN = r"(?i)^Key cost category\s*/\s*(Capability Acquisition Program|Capability Sustainment Program)\s*$"
DANGLING_NUMBER = r"\b\d{1,2}(?:\.\d{1,2}){0,2}\s*[\-–—]\s*$"
BARE_TERMS = ("other", "gains", "other gains", "losses", "n.e.c.", "nec")
MAX_LENGTH = 180
PUBLISHABLE = ("program", "outcome", "component")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clean_label(text: Column, default: str = "Unknown") -> Column:
    """One line, no path separator, never empty; labels are keys, so they are never cut."""
    cut = F.replace(squeeze(text), F.lit(" / "), F.lit(" – "))
    return F.coalesce(F.nullif(F.trim(cut), F.lit("")), F.lit(default))


def classified_segment(name: Column) -> Column:
    """The path segment to classify: the last one, or the last two for a key cost category."""
    parts = F.split(name, " / ")
    pair = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), " / ")
    return F.when(pair.rlike(KEY_COST), pair).otherwise(F.element_at(parts, -1))


def label_facts(raw: Column) -> Column:
    """What the tests look at: the squeezed label, its remainder, and its token counts."""
    label = squeeze(raw)
    return F.struct(
        label.alias("label"),
        F.regexp_count(label, F.lit(VALUE_TOKEN)).alias("values"),
        label.rlike(YEAR_TOKEN).alias("has_year"),
        F.regexp_count(label, F.lit(ACCOUNTING_HEADINGS)).alias("headings"),
        squeeze(F.regexp_replace(F.regexp_replace(label, YEAR_TOKEN, " "), UNIT_TOKEN, " ")).alias("rest"),
    )


def classify(raw: Column) -> Column:
    """Struct ``(label_class, rejection)`` as one expression, for use inside other expressions."""
    return F.get(F.transform(F.array(label_facts(raw)), _verdict), F.lit(0))


def with_class(df: DataFrame, text: Column, name: str = "c") -> DataFrame:
    """The same as a column, in two steps: facts first, then the tests over them.

    Spark does not merge the steps, since the facts are used many times, so each pattern runs once per
    row and both steps stay in generated code.
    """
    return df.withColumn("_facts", label_facts(text)).withColumn(name, _verdict(F.col("_facts"))).drop("_facts")


def _verdict(z: Column) -> Column:
    label, rest, values, headings = z["label"], z["rest"], z["values"], z["headings"]
    has_year = z["has_year"]
    lowered = F.btrim(F.lower(rest), F.lit(" -–—:"))
    first = F.substring(label, 1, 1)

    def verdict(name: str, why: str | None) -> Column:
        return F.struct(F.lit(name).alias("label_class"), F.lit(why).cast("string").alias("rejection"))

    broken = "malformed_concatenated_row"
    lower_first = (first == F.lower(first)) & (first != F.upper(first))
    rest_first = F.substring(rest, 1, 1)
    upper_first = (rest_first == F.upper(rest_first)) & (rest_first != F.lower(rest_first))
    return (
        F.when(label == "", verdict("unknown", "empty_label"))
        .when((rest == "") & has_year, verdict("year_header", "year_sequence_only"))
        .when(rest == "", verdict("unit_header", "unit_marker_only"))
        .when(values >= 3, verdict(broken, "three_or_more_embedded_value_tokens"))
        .when(label.rlike(BARE_NUMERIC_RUN), verdict(broken, "embedded_bare_numeric_run"))
        .when(has_year & (headings > 0), verdict(broken, "year_header_glued_to_accounting_line"))
        .when(headings >= 2, verdict(broken, "repeated_accounting_heading"))
        .when(label.rlike(DANGLING_NUMBER), verdict(broken, "truncated_trailing_numeric_token"))
        .when(F.length(label) > MAX_LENGTH, verdict(broken, "exceeds_justified_max_length"))
        .when(label.rlike(OUTCOME_NUMBER), verdict("outcome", None))
        .when(label.rlike(COMPONENT_NUMBER), verdict("component", None))
        .when(label.rlike(PROGRAM_NUMBER) | label.rlike(KEY_COST_KNOWN), verdict("program", None))
        .when(label.rlike(KEY_COST), verdict("unknown", "key_cost_category_not_in_verified_whitelist"))
        .when(label.rlike(NARRATIVE_LEAD), verdict("narrative_fragment", "narrative_continuation_lead"))
        .when(lower_first, verdict("narrative_fragment", "starts_lowercase"))
        .when(label.rlike(ACT_CITATION) & (F.length(label) < 60), verdict("narrative_fragment", "bare_legislative_citation"))
        .when(lowered.isin(*BARE_TERMS), verdict("narrative_fragment", "bare_generic_term_no_supporting_context"))
        .when(label.rlike(r"(?i)^Total\b"), verdict("total", "total_or_subtotal_line"))
        .when(label.rlike(TOTAL_SUBTOTAL), verdict("subtotal", "total_or_subtotal_line"))
        .when((headings > 0) & (values == 0), verdict("table_header", "accounting_heading_no_values"))
        .when(lowered.isin(*LINE_ITEMS), verdict("financial_statement_line", "known_line_item_vocabulary"))
        .when((F.length(rest) >= 8) & (F.length(rest) <= MAX_LENGTH) & upper_first, verdict("program", None))
        .otherwise(verdict("unknown", "no_confident_signal"))
    )


def publishable(label_class: Column) -> Column:
    return label_class.isin(*PUBLISHABLE)

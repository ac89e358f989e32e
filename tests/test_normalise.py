import pytest
from pyspark.sql import functions as F

from factline.functions import amounts as A
from factline.functions import labels as L
from factline.functions import years as Y
from factline.operators import cells as C
from factline.operators import textlines as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "label,want",
    [
        ("2028-29  2029-30", "year_header"), ("$'000", "unit_header"), ("", "unknown"), ("Outcome 1: Support", "outcome"), ("Program 1.1 – Aged care", "program"),
        ("1.5.6 - Component 6 (Carer Adjustment Payment) Annual administered expenses", "component"), ("Administered payments 1.5 -", "malformed_concatenated_row"),
        ("Rent 150 150 100", "malformed_concatenated_row"), ("2024-25 EXPENSES Employees", "malformed_concatenated_row"), ("plus: other things", "narrative_fragment"),
        ("Social Security Act 1991", "narrative_fragment"), ("Other", "narrative_fragment"), ("Net cash from operations", "subtotal"), ("Total expenses", "total"),
        ("OWN-SOURCE INCOME", "table_header"), ("Suppliers", "financial_statement_line"), ("Key cost category / Capability Sustainment Program", "program"),
        ("Key cost category / Operating", "unknown"), ("Family assistance", "program"), ("Abc", "unknown"), ("X" * 181, "malformed_concatenated_row"),
    ],
)
def test_label_classes(spark, label, want):
    assert one(spark, L.classify(F.lit(label)))["label_class"] == want
    two = L.with_class(spark.createDataFrame([(label,)], "t string"), F.col("t")).collect()[0].c
    assert two["label_class"] == want


def test_split_thousands(spark):
    assert one(spark, A.repair_thousands(F.lit("54,9 53 and 2, 374"))) == "54,953 and 2,374"


@pytest.mark.parametrize("raw,want", [("$1.5bn", 1.5e9), ("(12m)", 12e6), ("1,234", 1.234e9), ("750000", 750000.0), ("-", None), ("Total", None)])
def test_amounts(spark, raw, want):
    assert one(spark, A.parse_amount(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("17-Jul-26", "2026-07-17"), ("21/11/2035", "2035-11-21"), ("1.2.24", "2024-02-01"), ("2024-06-30", "2024-06-30"), ("soon", None)])
def test_dates(spark, raw, want):
    got = one(spark, A.parse_date(F.lit(raw)))
    assert (str(got) if got else None) == want


def test_years(spark):
    assert one(spark, Y.fy_from_label(F.lit("2025"))) == "2024-25"
    assert one(spark, Y.normalise_fy_token(F.lit("2024­25"))) == "2024-25"
    assert one(spark, Y.expand_two_digit_years(F.array(*[F.lit(t) for t in ("1998-99", "99-00", "00-01")]))) == ["1998-99", "1999-00", "2000-01"]
    assert str(one(spark, Y.period_end(F.lit("2015-16"), F.lit("February")))) == "2016-02-29"


def test_header_status_hints(spark):
    line = "2024-25 Estimated actual" + " " * 30 + "2025–26 Budget" + " " * 30 + "2026­27 Forward estimate"
    got = one(spark, T.year_header(F.lit(line)))
    assert [(c.fy, c.status) for c in got] == [("2024-25", "estimated_actual"), ("2025-26", "budget"), ("2026-27", "forward_estimate")]
    assert one(spark, T.year_header(F.lit("only 2024-25"))) is None


HEADER = (" " * 30).join(["2024-25 Estimated actual", "2025-26 Budget", "2026-27 Forward estimate"])


def table(spark, *texts, source="federal_x", per_page=None):
    rows, page = [], 1
    for i, t in enumerate(texts):
        if t == "\f":
            page += 1
            continue
        rows.append((source, page, i, t))
    return spark.createDataFrame(rows, "source_id string, page int, line_no int, text string")


def run(lines):
    facts, bad = T.program_tables(lines)
    return {(r.label, r.financial_year): r.amount_aud for r in facts.collect()}, [r.reason for r in bad.collect()]


def test_program_table_wrapped_label_nil_row_and_act_year(spark):
    got, bad = run(table(
        spark, "Program expenses 1.1", "Expenses - - - -", HEADER, "Program 1.1: a rather", "long title 1,000 2,000 3,000", "Nil program row - - - -",
        "Social Security (Administration) Act 1999 131,744 138,606 140,000", "Employees 1,000 2,000 3,000", "Total expenses 1,000 2,000 3,000",
    ))
    assert got[("Program 1.1: a rather long title", "2025-26")] == 2_000_000
    assert got[("Social Security (Administration) Act 1999", "2024-25")] == 131_744_000
    assert len(got) == 6 and not bad


def test_program_table_header_carries_over_pages_and_stops(spark):
    got, _ = run(table(
        spark, "Program expenses 1.1", "Expenses - - - -", HEADER, "Program 1.1: first long title 1,000 2,000 3,000", "\f", "Program 1.2: second long title 4,000 5,000 6,000",
        "Table 3.1: Budgeted Financial Statements", "Program 1.3: after the stop 7,000 8,000 9,000",
    ))
    assert {k[0] for k in got} == {"Program 1.1: first long title", "Program 1.2: second long title"}


def test_program_table_without_header_is_quarantined(spark):
    got, bad = run(table(spark, "Program expenses 1.1", "Expenses - - - -", "Program 1.1: some long title 1,000 2,000 3,000"))
    assert not got and bad == ["no_year_evidence_quarantine"]


def test_program_table_template_needs_a_budget_year(spark):
    got, bad = run(table(spark, "Program expenses 1.1", "Expenses - - - -", "Program 1.1: some long title 1,000 2,000 3,000 4,000 5,000 6,000", source="pbs_2024_25_x"))
    assert len(got) == 5 and not bad  # actual and budget of one year share a key here
    assert got[("Program 1.1: some long title", "2023-24")] == 1_000_000


def test_label_line_then_numbers_only(spark):
    got, _ = run(table(spark, "Cost Summary for Program", "Expenses - - - -", HEADER, "Program 2.1 Navy Total funded expenditure", "1,000 2,000 3,000"))
    assert got[("Program 2.1 Navy Total funded expenditure", "2026-27")] == 3_000_000


def walk(texts, keep=4):
    """Label in waiting of each row of numbers, line by line."""
    import re

    waits, out = [], []
    for t in texts:
        if re.match(T.NIL_ROW, t):
            waits = []
        elif waits and re.match(T.NUMBERS_ONLY, t):
            out.append(("serve", " ".join(waits)))
            waits = []
        elif m := re.match(T.TAIL, t):
            out.append(("tail", " ".join([*waits, m[1]])))
            waits = []
        else:
            waits = [*waits, t][-keep:] if keep else [*waits, t]
    short = lambda label: re.match(T.SHORT_HEADS, label) and len(label) < 20
    return [label for kind, label in out if (len(label) >= 4 and not short(label) if kind == "tail" else re.search(r"Program\s+\d", label))]


def test_runs_of_numbers_of_mixed_width(spark):
    import random

    rnd = random.Random(4)
    bare = ["1 2 3", "4 5 6 7", "7,000 8 9 10 11", "2 3 4"]
    texts = []
    for i in range(60):
        texts.append(f"Program {i}.1 heading number {i}")
        texts += [rnd.choice(["text above", *bare, *bare, f"Program {i}.2 a title of its own 1 2 3"]) for _ in range(rnd.randrange(7))]
        if i % 9 == 0:
            texts.append("Nil program row - - - -")
    for keep in (4, None):
        facts, bad = T.program_tables(table(spark, "Program expenses", "Expenses - - - -", HEADER, *texts), label_lines=keep)
        got = {(r.page, r.line_no, r.label) for r in facts.collect()} | {(r.page, r.line_no, r.label) for r in bad.collect()}
        assert sorted(label for _, _, label in got) == sorted(walk(texts, keep))


def test_labels_of_many_lines(spark):
    words = [f"word {i}x" for i in range(30)]
    lines = table(spark, "Program expenses", "Expenses - - - -", HEADER, *words, "Program 1.1 end 1,000 2,000 3,000")
    whole = " ".join([*words, "Program 1.1 end"])
    for keep, want in ((None, whole), (4, " ".join([*words[-4:], "Program 1.1 end"]))):
        facts, _ = T.program_tables(lines, label_lines=keep)
        assert {r.label for r in facts.collect()} == {want}
    rows = T.function_rows(spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(["Health", *words, "Hospitals 1 2", "Fuel", "and", "Energy 3 4"])], "source_id string, page int, line_no int, text string"), ["Health", "Fuel and Energy"])
    assert [r.category for r in rows.orderBy("line_no").collect()] == ["Health / " + " ".join(words) + " Hospitals", "Fuel and Energy"]


def test_labelled_row_needs_a_word_boundary(spark):
    lines = spark.createDataFrame([("s", "Revenues 1 2 3 4"), ("s", "Revenue 1,000 (2) 3 4"), ("s", "Revenue 5")], "source_id string, text string")
    rows, bad = T.labelled_rows(lines, [("Revenue", "rev")], 4)
    assert [r.numbers[:2] for r in rows.collect()] == [[1000.0, -2.0]] and bad.count() == 1


def test_grid_without_header_gives_nothing(spark):
    cells = spark.createDataFrame([("w", "s", 0, 0, "a"), ("w", "s", 1, 1, "5")], "source_id string, sheet string, row_no int, col_no int, value string")
    rows = C.rows_of(cells)
    assert C.melt(rows, C.header_cells(rows)).count() == 0

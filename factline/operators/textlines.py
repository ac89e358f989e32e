"""Facts out of numbered text lines ``(source_id, page, line_no, text)``.

What a reader keeps in mind from line to line (the section, the year header, a label split over
lines) is carried by block-wise windows, so a document with most of the lines is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions import amounts as A
from factline.functions.years import FY_TOKEN, fy_label, normalise_fy_token
from factline.operators.ordered import dense_ordinal, fill_forward, first_per_key, place, switch_scan, with_neighbours, within_distance
from factline.session import cut_lineage

DOC = ["source_id"]
PLACE = ["page", "line_no"]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once per row, however often later filters and columns use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


# Sections and blocks


def split_sections(lines: DataFrame, keys: Sequence[str], pattern: str, start: str = "table", notes: str = "as_at_note") -> DataFrame:
    """Rows with their section and its number; the first row of a section is its header.

    Every marker opens a section of its own, also if its name came before; what stands before the first marker, or in a file
    without one, is the section ``start``.  Markers, blank lines and lines that begin with ``notes`` drop out.
    """
    keys = list(keys)
    mark = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    opened = F.when(mark.isNotNull(), F.col("line_no"))
    filled = fill_forward(lines.withColumn("_mark", mark).withColumn("section", mark).withColumn("section_line", opened), keys, ["line_no"], ["section", "section_line"])
    noise = (F.trim("text") == "") | F.col("text").startswith(notes)
    rows = filled.where(F.col("_mark").isNull() & ~noise).drop("_mark")
    rows = rows.withColumn("section", F.coalesce("section", F.lit(start))).withColumn("section_line", F.coalesce("section_line", F.lit(-1)))
    first = rows.groupBy(*keys, "section_line").agg(F.min("line_no").alias("_first"))
    return rows.join(first, [*keys, "section_line"]).withColumn("is_header", F.col("line_no") == F.col("_first")).drop("_first")


def melt_year_rows(wide: DataFrame, ids: Sequence[str], metrics: Mapping[str, str], statuses: DataFrame, kind: str) -> DataFrame:
    """One row per metric; the type cell gives the status, an unknown type gives a reason instead."""
    long = wide.select(*ids, *[F.col(c).alias(n) for c, n in metrics.items()]).unpivot(list(ids), list(metrics.values()), "metric", "amount")
    j = long.where(F.col("amount").isNotNull()).join(statuses, kind, "left")
    return j.withColumn("reason", F.when(F.col("estimate_status").isNull(), "unknown_type"))


def block_status(lines: DataFrame, blocks: Mapping[str, str | None]) -> DataFrame:
    """Rows under a block heading take its status; a block mapped to None is never read."""
    key = F.lower(squeeze(F.col("text")))
    status = F.lit(None).cast("string")
    for heading, value in blocks.items():
        status = F.when(key == heading.lower(), F.lit(value if value is not None else "")).otherwise(status)
    marked = lines.withColumn("_is", key.isin(*[b.lower() for b in blocks])).withColumn("estimate_status", status)
    out = fill_forward(marked, DOC, PLACE, ["estimate_status"])
    return out.where(~F.col("_is") & (F.coalesce("estimate_status", F.lit("")) != "")).drop("_is")


# Debt schedules

# Shape of a coupon.
COUPON = r"(?:\d{1,2}(?:\.\d+)?\s*%|(?:\d+[dm]\s+)?(?:BBSW|AONIA)\s*\+?\s*\d+(?:\.\d+)?\s*bp)"
TRIPLE = rf"(?i)({COUPON})\s+({A.DATE_TOKEN})\s+([0-9][0-9,]*(?:\.[0-9]+)?)"


def debt_triples(lines: DataFrame, text: str = "text") -> DataFrame:
    """Every coupon, maturity and amount of every line; two-column layouts give several per line."""
    get = lambda i: F.regexp_extract_all(F.col(text), F.lit(TRIPLE), i)
    keep = [c for c in lines.columns if c != text]
    spread = lines.select(*keep, F.explode(F.arrays_zip(get(1).alias("c"), get(2).alias("d"), get(3).alias("a"))).alias("t"))
    return spread.select(
        *keep, F.trim("t.c").alias("coupon"), A.parse_date(F.col("t.d")).alias("maturity"), F.replace("t.a", F.lit(","), F.lit("")).try_cast("double").alias("amount")
    ).where(F.col("amount") > 0)


# Year headers

# Status words near a year, in order of preference.
STATUS_HINTS = (
    (r"(?i)estimated\s+actual|est\.?\s*actual", "estimated_actual"),
    (r"(?i)forward\s+estimate", "forward_estimate"),
    (r"(?i)revised", "revised_estimate"),
    (r"(?i)\bbudget\b", "budget"),
    (r"(?i)\bactual\b|outcome", "actual"),
)
SPAN_BACK = 24


def year_header(line: Column) -> Column:
    """Ordered ``(fy, status)`` columns of a header line, null when it names fewer than two years.

    The tokens and the text between them are bound once, so each pattern runs once per line.
    """
    tokens = F.regexp_extract_all(line, F.lit(FY_TOKEN), 1)
    gaps = F.split(F.regexp_replace(line, FY_TOKEN, "\u0001"), "\u0001")

    def spans(z: Column) -> Column:
        def span(tok: Column, i: Column) -> Column:
            woven = F.flatten(F.zip_with(F.slice(z["g"], F.lit(1), i), F.slice(z["t"], F.lit(1), i), lambda g, t: F.array(g, t)))
            before = F.concat(F.array_join(woven, ""), F.get(z["g"], i))
            back = F.right(before, F.lit(SPAN_BACK))
            return F.struct(tok.alias("tok"), i.alias("i"), F.concat(back, tok, F.coalesce(F.get(z["g"], i + 1), F.lit(""))).alias("span"))

        return F.transform(z["t"], span)

    def column(x: Column) -> Column:
        status = F.lit("budget")
        for pattern, name in reversed(STATUS_HINTS):
            status = F.when(x["span"].rlike(pattern), name).otherwise(status)
        lone = (status == "budget") & (x["i"] == 0) & F.lower(line).contains("actual")
        return F.struct(normalise_fy_token(x["tok"]).alias("fy"), F.when(lone, "actual").otherwise(status).alias("status"))

    bound = F.get(F.transform(F.array(F.struct(tokens.alias("t"), gaps.alias("g"))), spans), F.lit(0))
    return F.when(line.rlike(FY_TOKEN + ".*" + FY_TOKEN), F.transform(bound, column))


def budget_template(start: Column) -> Column:
    """Six declared columns of a budget year: actual, estimated actual, budget, three forward years."""
    def col(offset: int, status: str) -> Column:
        return F.struct(fy_label(start + offset).alias("fy"), F.lit(status).alias("status"))

    fe = "forward_estimate"
    return F.array(col(-1, "actual"), col(0, "estimated_actual"), col(0, "budget"), col(1, fe), col(2, fe), col(3, fe))


def align_years(n: Column, header: Column, template: Column | None = None, budget_year: Column | None = None) -> Column:
    """``(columns, reason)``: exact header, else its rightmost columns, else a template, else quarantine.

    What is given is bound once, so a header that is parsed in place is parsed once per row, not once per use.
    """
    columns = "array<struct<fy:string,status:string>>"
    none = F.lit(None).cast(columns)
    given = {"n": n, "header": header, "template": none if template is None else template, "year": F.lit(None).cast("string") if budget_year is None else budget_year}

    def answer(cols: Column, why: str) -> Column:
        return F.struct(cols.cast(columns).alias("columns"), F.lit(why).alias("reason"))

    def choose(z: Column) -> Column:
        n, header, template = z["n"], z["header"], z["template"]
        h, t = F.size(header), F.size(template)
        return (
            F.when(n < 2, answer(none, "too_few_numeric_columns"))
            .when(header.isNotNull() & (h == n), answer(header, "table_header_exact"))
            .when(header.isNotNull() & (h > n), answer(F.slice(header, h - n + 1, n), "table_header_right_align"))
            .when(header.isNotNull(), answer(none, "header_column_count_mismatch"))
            .when(template.isNotNull() & (t == n), answer(template, "source_layout_template"))
            .when(template.isNotNull() & (t > n), answer(F.slice(template, t - n + 1, n), "source_layout_template_right_align"))
            .when(z["year"].isNotNull(), answer(none, "missing_year_header_quarantine"))
            .otherwise(answer(none, "no_year_evidence_quarantine"))
        )

    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in given.items()])), choose), F.lit(0))


# Labelled rows


def labelled_rows(
    lines: DataFrame, labels: Sequence[tuple[str, str]], least: int, exact: int | None = None, editions: Mapping[str, tuple[str, str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of lines that start with a known label, the longest label first.

    A label counts only up to a word boundary; a row needs ``least`` numbers, or just ``exact`` ones.  ``editions`` says from which to
    which ``edition`` of the lines a label counts; outside of them it is no label.
    """
    text = F.trim(F.col("text"))
    hit = F.lit(None).cast("struct<label:string,measure:string>")
    for label, measure in sorted(labels, key=lambda x: len(x[0])):
        edge = F.substring(text, len(label) + 1, 1)
        starts = F.startswith(text, F.lit(label)) & ((edge == "") | edge.rlike(r"\s"))
        if editions and label in editions:
            starts = starts & F.col("edition").between(*editions[label])
        hit = F.when(starts, F.struct(F.lit(label).alias("label"), F.lit(measure).alias("measure"))).otherwise(hit)
    found = lines.withColumn("_h", hit).where(F.col("_h").isNotNull())
    rest = F.trim(F.col("text")).substr(F.length("_h.label") + 1, F.length("text"))
    found = found.withColumn("numbers", A.numbers(rest)).withColumn("label", F.col("_h.label")).withColumn("measure", F.col("_h.measure")).drop("_h")
    ok = (F.size("numbers") == exact) if exact is not None else (F.size("numbers") >= least)
    return found.where(ok), found.where(~ok).withColumn("reason", F.lit("unexpected_numeric_column_count"))


def between_markers(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Lines from a marker line up to the next end line."""
    state = F.when(F.col("text").rlike(start), "in").when(F.col("text").rlike(end), "out")
    return fill_forward(lines.withColumn("_s", state), DOC, PLACE, ["_s"]).where("_s = 'in'").drop("_s")


def value_on_later_line(lines: DataFrame, labels: DataFrame, n: int, reach: int = 15) -> DataFrame:
    """Numbers of a label line, else of the first letter-free line with ``n`` numbers in the next lines.

    ``lines`` carry a dense ``ordinal`` per source; ``labels`` are the label lines among them.
    """
    own = labels.withColumn("numbers", A.numbers(F.col("rest")))
    done = own.where(F.size("numbers") == n).select("source_id", "ordinal", "label", "numbers", F.lit(0).alias("distance"))
    open_ = own.where(F.size("numbers") != n).select("source_id", F.col("ordinal").alias("at"), "label")
    bare = lines.where(~F.col("text").rlike("[A-Za-z]")).withColumn("numbers", A.numbers(F.col("text"))).where(F.size("numbers") == n)
    near = within_distance(open_, bare.select("source_id", "ordinal", "numbers"), DOC, "at", "ordinal", 1, reach)
    best = near.groupBy("source_id", "at", "label").agg(F.min_by("numbers", "ordinal").alias("numbers"), F.min(F.col("ordinal") - F.col("at")).cast("int").alias("distance"))
    return done.unionByName(best.withColumnRenamed("at", "ordinal"))


# Function tables


def function_rows(lines: DataFrame, functions: Sequence[str]) -> DataFrame:
    """Function totals and sub-functions; the running function is carried down, split labels are joined, however many lines they have.

    A function's name may be split over as many lines as it has characters at most.
    """
    wrapped = max([1, *[len(f.replace(" ", "")) - 1 for f in functions]])
    tail = r"^(.*?)((?:\s+\(?-?[\d,]+(?:\.\d+)?\)?){2,})\s*$"
    text = squeeze(F.col("text"))
    amount = text.rlike(tail)
    base = lines.withColumn("text", text).where(F.col("text") != "")
    base = base.withColumn("_amt", amount).withColumn("_lab", F.when(amount, squeeze(F.regexp_extract(text, tail, 1))).otherwise(text))
    o = dense_ordinal(place(base, DOC, PLACE), DOC, PLACE)
    exprs = {}
    for k in range(1, wrapped + 1):
        exprs[f"_a{k}"] = ("_amt", -k)
        exprs[f"_l{k}"] = ("_lab", -k)
    o = with_neighbours(o, DOC, "ordinal", exprs)
    names = {f.lower().replace(" ", ""): f for f in functions}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    known = lambda c: F.try_element_at(table, F.replace(F.lower(c), F.lit(" "), F.lit("")))
    # a text line alone, or with the text lines right above it, may spell a function
    open_, joined, fn = F.lit(True), F.col("_lab"), known(F.col("_lab"))
    for k in range(1, wrapped + 1):
        open_ = open_ & (F.col(f"_a{k}") == F.lit(False))
        joined = F.concat_ws(" ", f"_l{k}", joined)
        fn = F.coalesce(fn, F.when(F.coalesce(open_, F.lit(False)), known(joined)))
    o = o.withColumn("_fn", F.when(~F.col("_amt"), fn))
    # split labels: all text lines above an amount line, down from the last amount or function heading
    o = switch_scan(o.select("source_id", *PLACE, "text", "_amt", "_lab", "_fn"), DOC, PLACE, F.lit(None).cast("string"), lambda _: F.col("_amt") | F.col("_fn").isNotNull())
    o = cut_lineage(o.drop("before"))
    rows_at = o.where("_amt").select(F.col("source_id").alias("_doc"), F.col("group").alias("_group"))
    waits = o.where(~F.col("_amt") & F.col("_fn").isNull()).join(rows_at, F.col("source_id").eqNullSafe(F.col("_doc")) & (F.col("group") == F.col("_group")))
    waits = waits.groupBy("_doc", "_group").agg(F.array_sort(F.collect_list(F.struct("ordinal", "_lab"))).alias("_w"))
    waits = waits.select("_doc", "_group", F.array_join(F.transform("_w", lambda w: w["_lab"]), " ").alias("_above"))
    o = o.join(waits, F.col("_amt") & F.col("source_id").eqNullSafe(F.col("_doc")) & (F.col("group") == F.col("_group")), "left").drop("_doc", "_group")
    o = o.withColumn("label", squeeze(F.concat_ws(" ", "_above", "_lab")))
    total = F.nullif(F.regexp_extract("label", r"(?i)^Total\s+(.+)$", 1), F.lit(""))
    grand = F.lower(total) == "expenses"
    own = F.when(grand, F.lit("")).otherwise(F.coalesce(known(total), total, known(F.col("label"))))
    event = F.when(F.col("_amt"), own).otherwise(F.col("_fn"))
    o = fill_forward(o.withColumn("_own", F.when(F.col("_amt"), own)).withColumn("function", event), DOC, ["ordinal"], ["function"])
    rows = o.where(F.col("_amt") & (F.coalesce("function", F.lit("")) != ""))
    numbers_ = A.numbers(F.regexp_extract("text", tail, 2))
    return rows.select(
        "source_id", *PLACE, "function", "label", F.when(F.col("_own").isNotNull(), "total").otherwise("subfunction").alias("row_kind"),
        F.when(F.col("_own").isNotNull(), F.col("function")).otherwise(F.concat_ws(" / ", "function", "label")).alias("category"), numbers_.alias("numbers"),
    )


def outcome_number(numbers: Column) -> Column:
    """Third of three and more numbers is the outcome, else the last."""
    return F.when(F.size(numbers) >= 3, F.get(numbers, F.lit(2))).otherwise(F.try_element_at(numbers, F.lit(-1)))


def strict_columns(rows: DataFrame, years: Column, numbers: str = "numbers") -> DataFrame:
    """Rows whose number count equals the header's; others are skipped, never shifted."""
    fit = rows.withColumn("_y", years).where(F.size(numbers) == F.size("_y"))
    return fit.withColumn("_z", F.explode(F.arrays_zip(F.col("_y").alias("fy"), F.col(numbers).alias("v")))).select(
        *rows.columns, F.col("_z.fy").alias("financial_year"), F.col("_z.v").alias("amount")
    )


def historical_series(lines: DataFrame, which: int) -> DataFrame:
    """Lines that start with a year: the n-th number, estimates marked ``(e)``; the first row of a year stands."""
    text = squeeze(F.col("text"))
    fy = F.regexp_extract(text, r"^(\d{4}-\d{2})\b", 1)
    rest = F.regexp_replace(text, r"^\d{4}-\d{2}\s*(?:\(e\))?", "")
    value = F.get(A.numbers(rest), F.lit(which - 1))
    rows = lines.select("source_id", *PLACE, fy.alias("financial_year"), value.alias("amount"), F.when(text.contains("(e)"), "forward_estimate").otherwise("audited_actual").alias("estimate_status"))
    return first_per_key(rows.where((F.col("financial_year") != "") & F.col("amount").isNotNull()), ["source_id", "financial_year"], [F.col("page"), F.col("line_no")])


def header_total_pairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, mismatches): program titles paired with the total line that names the same code."""
    head = r"(?i)^Program\s+(\d+\.\d+)\s*[:\-–—]\s*(.+)$"
    total = r"(?i)^Total expenses for Program\s+(\d+\.\d+)\s+(.*)$"
    text = squeeze(F.col("text"))
    code, title = F.nullif(F.regexp_extract(text, head, 1), F.lit("")), F.nullif(F.regexp_extract(text, head, 2), F.lit(""))
    marked = lines.withColumn("code", code).withColumn("title", title)
    filled = fill_forward(marked, DOC, PLACE, ["code", "title"])
    t = filled.where(text.rlike(total)).withColumn("total_code", F.regexp_extract(text, total, 1)).withColumn("numbers", A.numbers(F.regexp_extract(text, total, 2)))
    same = F.coalesce(F.col("code") == F.col("total_code"), F.lit(False))
    return t.where(same), t.where(~same).withColumn("reason", F.lit("program_code_mismatch"))


def named_programs(lines: DataFrame, programs: Sequence[tuple[str, str]]) -> DataFrame:
    """Lines that name a known program, under its fixed parent; the first name in order wins."""
    low = F.lower(F.col("text"))
    parent, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for known, path in reversed(list(programs)):
        hit = low.contains(known.lower())
        parent, name = F.when(hit, path).otherwise(parent), F.when(hit, known).otherwise(name)
    rows = lines.withColumn("program", name).withColumn("category", F.concat_ws(" / ", parent, name)).where(F.col("program").isNotNull())
    return rows.withColumn("numbers", A.numbers(F.col("text"))).where(F.size("numbers") > 0)


def join_wrapped(lines: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Label lines split in two become one line; ``lines`` carry a dense ``ordinal``; digits are repaired."""
    n = with_neighbours(lines, DOC, "ordinal", {"_next": ("text", 1), "_prev": ("text", -1)})
    low, nxt, prev = F.lower(F.trim("text")), F.lower(F.coalesce("_next", F.lit(""))), F.lower(F.trim(F.coalesce("_prev", F.lit(""))))
    head, taken = F.lit(False), F.lit(False)
    for first, second in pairs:
        head = head | ((low == first) & nxt.startswith(second))
        taken = taken | ((prev == first) & low.startswith(second))
    out = n.where(~taken).withColumn("text", F.when(head, F.concat_ws(" ", F.trim("text"), F.trim("_next"))).otherwise(F.col("text")))
    return out.drop("_next", "_prev").withColumn("text", A.repair_thousands(squeeze(F.col("text"))))


def best_page(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per document the page with most rows, then fewest rejects, then the earliest."""
    n = rows.groupBy("source_id", "page").agg(F.count(F.lit(1)).alias("n_rows"))
    r = rejects.groupBy("source_id", "page").agg(F.count(F.lit(1)).alias("n_rejects"))
    j = n.join(r, ["source_id", "page"], "left").withColumn("n_rejects", F.coalesce("n_rejects", F.lit(0)))
    return first_per_key(j, DOC, [-F.col("n_rows"), F.col("n_rejects"), F.col("page")])


# Program tables

# Lines that open, close, pad or end a program table; how many lines of a label count.
START_PAGE = (
    r"(?i)Table\s+2\.1|Program expenses|Expenses for Outcome|Budgeted expenses for Outcome|Budget Expenses and Performance|"
    r"Budgeted Expenses and Performance|Cost Summary for Program|Planned Expenditure by Key Cost Category"
)
KEEP_TABLE = r"(?i)Table\s+\d+.*(?:Cost Summary|Budgeted Resources|Program|Outcome|Key Cost)"
STOP_TABLE = r"(?i)Budgeted Financial Statements|Explanatory Tables|Section\s+3"
SKIP_LINE = r"(?i)^(?:\|?\s*Budget Paper|Page \d+|Statement 6|Appendix|Table A\.6\.1|Actual|Estimates|\$m|\d{4}-\d{2}|a\)\s|This page)"
FRAGMENT = r"(?i)^(?:Estimated|Actual|Budget|Estimate|Forward|Revised|Outcome|(?:\$'?000|\$m)(?:\s+(?:\$'?000|\$m))*)\s*$"
TAIL = r"^(.*?)((?:\s+-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\s+-?\d+(?:\.\d+)?){3,6})\s*$"
NUMBERS_ONLY = r"^(?:-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)(?:\s+(?:-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)){2,6}\s*$"
NIL_ROW = r"^[A-Za-z][A-Za-z0-9 ,\-&/()\[\]]*?\s+(?:-\s+){2,}-\s*$"
PROGRAM_TOTAL = r"(?i)Program\s+\d+(?:\.\d+)?\b.*?Total funded expenditure"
KEY_COST_ROW = r"^(?:\d+\s+)?([A-Za-z][A-Za-z0-9 ,\-&/]+?)\s+((?:-?\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:\s+|$)){3,6})\s*$"
SHORT_HEADS = r"(?i)^(?:Outcome|Program|Departmental|Administered)\b"
DROPPED_ROWS = r"(?i)^(?:Employees|Suppliers|Other expenses)\b"
PLAIN_NUMBER = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"
LABEL_LINES = 4
THOUSANDS, MILLIONS = 1_000, 1_000_000


def _captured(lines: DataFrame) -> DataFrame:
    """Lines inside program tables with the columns of their running year header; closing lines stay, as resets.

    A header is parsed where it stands, once, and its columns are carried down; empty columns stand for none.
    """
    text = F.trim("text")
    base = lines.withColumn("text", text).where(F.col("text") != "")
    opens = base.groupBy("source_id", "page").agg(F.max(F.col("text").rlike(START_PAGE)).alias("_open"), F.min("line_no").alias("_top"))
    base = base.join(opens, ["source_id", "page"])
    closes = F.col("text").rlike(r"^Table\s+\d") & ~F.col("text").contains("2.1") & ~F.col("text").rlike(KEEP_TABLE) & F.col("text").rlike(STOP_TABLE)
    base = base.withColumn("_stop", closes)
    state = F.when(F.col("_stop"), "off").when(F.col("_open") & (F.col("line_no") == F.col("_top")), "on")
    s = fill_forward(base.withColumn("_state", state), DOC, PLACE, ["_state"])
    live = s.where((F.col("_state") == "on") | F.col("_stop"))
    years = F.size(F.regexp_extract_all("text", F.lit(FY_TOKEN), 1))
    live = live.withColumn("_is_header", ~F.col("_stop") & (years >= 3))
    none = F.array().cast("array<struct<fy:string,status:string>>")
    header = F.when(F.col("_stop"), none).when(F.col("_is_header"), F.coalesce(year_header(F.col("text")), none))
    return fill_forward(live.withColumn("_header", header), DOC, PLACE, ["_header"]).drop("_open", "_top", "_state")


def _act_year(label: Column, nums: Column) -> Column:
    """A bare four-digit first token after "... Act" belongs to the label."""
    first = F.get(nums, F.lit(0))
    hit = F.coalesce(first.rlike(r"^-?\d{4}$"), F.lit(False)) & label.rlike(r"(?i)\bAct$")
    rest = F.slice(nums, F.lit(2), F.greatest(F.size(nums), F.lit(1)))
    return F.when(hit, F.struct(F.concat_ws(" ", label, first).alias("label"), rest.alias("nums"))).otherwise(F.struct(label.alias("label"), nums.alias("nums")))


def program_tables(lines: DataFrame, defence: Column | None = None, label_lines: int | None = LABEL_LINES) -> tuple[DataFrame, DataFrame]:
    """(facts, quarantine) of program expense tables.

    Lines above a numeric line that hold no numbers are its label, the last ``label_lines`` of them (None: all, however many);
    headers, page furniture and status words are passed over; an all-dash row clears the label in waiting.  A line of numbers
    only serves the label above it; without one, three numbers wait as a label, and more are a row labelled by the first.
    """
    live = _captured(place(lines, DOC, PLACE))
    text = F.col("text")
    key_cost = (F.coalesce(defence, F.lit(False)) if defence is not None else F.lit(False)) & ~text.rlike(TAIL) & text.rlike(KEY_COST_ROW) & ~F.lower(text).startswith("total") & text.rlike(r"[.,]\d")
    live = live.withColumn("_key", ~F.col("_stop") & ~F.col("_is_header") & ~text.rlike(SKIP_LINE) & key_cost)
    passed = F.col("_is_header") | text.rlike(SKIP_LINE) | text.rlike(FRAGMENT) | F.col("_key")
    kind = F.when(F.col("_stop") | text.rlike(NIL_ROW), "reset").when(text.rlike(NUMBERS_ONLY), "nums").when(text.rlike(TAIL), "tail").otherwise("text")
    # A label waits or does not.  Three bare numbers serve the label in waiting, and are themselves kept as one if there is none: they
    # turn the state over.  More of them serve as well, but else are a row whose label is the first number: they end it either way.
    bare = text.rlike(NUMBERS_ONLY)
    move = F.when(F.col("_stop") | text.rlike(NIL_ROW), "off").when(bare & ~text.rlike(TAIL), "flip").when(text.rlike(TAIL), "off").otherwise("on")
    o = live.where(F.col("_stop") | ~passed).withColumn("_move", move).withColumn("_bare", bare)
    o = switch_scan(o, DOC, PLACE, F.col("_move"), lambda waiting: (F.col("_move") == "off") | ((F.col("_move") == "flip") & waiting))
    reset = F.col("_stop") | F.col("text").rlike(NIL_ROW)
    kind = F.when(reset, "reset").when(F.col("_bare") & F.col("before"), "serve").when(F.col("_move") == "off", "tail").otherwise("text")
    o = cut_lineage(o.withColumn("kind", kind).drop("_bare", "_move", "before"))
    rows = o.where(F.col("kind").isin("tail", "serve"))
    # of the lines that wait only those that some row takes are gathered, at most ``label_lines`` for each
    taken = rows.select(F.col("source_id").alias("_doc"), F.col("group").alias("_group"), F.col("ordinal").alias("_at"))
    waits = o.where(F.col("kind") == "text").join(taken, F.col("source_id").eqNullSafe(F.col("_doc")) & (F.col("group") == F.col("_group")))
    if label_lines is not None:
        waits = waits.where(F.col("_at") - F.col("ordinal") <= label_lines)
    waits = waits.groupBy("_doc", "_group").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_w"))
    waits = waits.select("_doc", "_group", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("_pending"))
    rows = rows.join(waits, F.col("source_id").eqNullSafe(F.col("_doc")) & (F.col("group") == F.col("_group")), "left").drop("_doc", "_group")
    tail = F.col("kind") == "tail"
    rows = bind(rows, _own=F.when(tail, F.regexp_extract(text, TAIL, 1)), _found=F.when(tail, F.regexp_extract(text, TAIL, 2)).otherwise(text))
    rows = bind(rows, _l=squeeze(F.concat_ws(" ", "_pending", "_own")), _nums=F.regexp_extract_all("_found", F.lit(f"({PLAIN_NUMBER})"), 1))
    rows = bind(rows, _ln=_act_year(F.col("_l"), F.col("_nums")))
    prefer = F.col("_l").rlike(PROGRAM_TOTAL)
    short = F.col("_l").rlike(SHORT_HEADS) & (F.length("_l") < 20) & ~prefer
    wanted_tail = (F.length("_l") >= 4) & (~F.lower("_l").startswith("total") | prefer) & ~short & ~F.col("_l").rlike(DROPPED_ROWS)
    wanted = F.when(tail, wanted_tail).otherwise(prefer | F.col("_l").rlike(r"(?i)Program\s+\d+"))
    cols = ["source_id", *PLACE, "_header"]
    main = rows.where(wanted).select(*cols, F.col("_ln.label").alias("label"), F.col("_ln.nums").alias("nums"), F.lit(THOUSANDS).alias("scale"), prefer.alias("prefer"))
    key_label = F.concat(F.lit("Key cost category / "), squeeze(F.regexp_extract(text, KEY_COST_ROW, 1)))
    key_rows = live.where("_key").select(*cols, key_label.alias("label"), F.regexp_extract_all(F.regexp_extract(text, KEY_COST_ROW, 2), F.lit(f"({PLAIN_NUMBER})"), 1).alias("nums"), F.lit(MILLIONS).alias("scale"), F.lit(True).alias("prefer"))
    out = main.unionByName(key_rows).where(F.size("nums") >= 3)
    start = F.regexp_extract("source_id", r"(20\d{2})[_-]\d{2}", 1).try_cast("int")
    out = out.withColumn("_h", F.when(F.size("_header") > 0, F.col("_header"))).withColumn("_start", start)
    template = F.when(F.col("_h").isNull() & F.col("_start").isNotNull(), budget_template(F.col("_start")))
    out = bind(out, _a=align_years(F.size("nums"), F.col("_h"), template, F.col("_start")))
    bad = out.where(F.col("_a.columns").isNull()).select("source_id", *PLACE, "label", F.array_join("nums", " ").alias("nums"), F.col("_a.reason").alias("reason"))
    spread = out.where(F.col("_a.columns").isNotNull()).withColumn("_z", F.explode(F.arrays_zip(F.col("_a.columns").alias("c"), F.col("nums").alias("v"))))
    amount = (F.replace("_z.v", F.lit(","), F.lit("")).try_cast("double") * F.col("scale")).cast("long")
    facts = spread.select(
        "source_id", *PLACE, "label", "prefer", F.col("_z.c.fy").alias("financial_year"), F.col("_z.c.status").alias("estimate_status"), amount.alias("amount_aud"), F.col("_a.reason").alias("inference")
    )
    return facts.where(F.col("amount_aud").isNotNull()), bad


def prefer_program_totals(facts: DataFrame) -> DataFrame:
    """Of rows equal in year, status, label and amount: program totals first, then the longer label."""
    keyed = facts.withColumn("_k", F.lower("label"))
    order = [F.when(F.col("prefer"), 0).otherwise(1), -F.length("label"), F.col("page"), F.col("line_no")]
    return first_per_key(keyed, ["source_id", "financial_year", "estimate_status", "_k", "amount_aud"], order).drop("_k")

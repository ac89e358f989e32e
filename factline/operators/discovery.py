"""Links that look like data files, and what a payload really is."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.ordered import first_per_key

# Fixed values, with the reasons that ``judge_links`` and ``validity`` give: link words, phrases and suffixes that mark data, names of query parameters that hold a file name, and payload signatures.
DOWNLOAD_WORDS = r"(?i)download|data|table|appendix|budget|statement|report|export|workbook"
STRONG_PHRASES = r"(?i)\bdownload\b|\bdataset\b|\bspreadsheet\b|\bworkbook\b|\bdata export\b|\bexport (?:file|data|to (?:csv|excel|xlsx))\b|\bbulk export\b"
DATA_SUFFIXES = (".csv", ".xlsx", ".xls", ".zip", ".pdf", ".docx", ".pptx", ".json", ".ods", ".ppt", ".doc", ".tsv")
NAME_PARAMETERS = ("name", "filename", "file", "download")
SIGNATURES = (
    ("executable", ("4D5A", "7F454C46")),
    ("gz", ("1F8B",)),
    ("pdf", ("255044462D",)),
    ("xls", ("D0CF11E0A1B11AE1",)),
    ("zip", ("504B0304",)),
)
# What marks the end of an archive, and an office file among archives.
ARCHIVE_END, OFFICE_TYPES = "PK\x05\x06", "[Content_Types].xml"
OFFICE_MEMBERS = (("xl/workbook.xml", "xlsx"), ("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"))
HTML_MARKERS = ("<!doctype html", "<html", "<head", "<body", "<script")
CHALLENGE_MARKERS = (
    "captcha", "access denied", "cloudflare", "verify you are human", "bot challenge", "request blocked", "sign in", "log in",
)
#: What stands in a tag after its name: a quote begins a value only after an equals sign, and then a ``>`` in it ends nothing.
ATTRIBUTES = r"(?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+"
#: In one pass over a page: scripts and styles with their content, comments, and tags, which alone stay.
MARKUP = rf"(?is)<(script|style)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|(</?[a-z]{ATTRIBUTES}>)"
TAG = rf"(?is)<[a-z][^\s/>]*({ATTRIBUTES})>"
# an anchor's attributes and content up to its end or the next anchor, or a link's attributes
LINK = rf"(?is)<a\b({ATTRIBUTES})>(.*?)(?=</a\s*>|<a\b|\z)|<link\b({ATTRIBUTES})>"
ATTRIBUTE = r"(?is)([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
# Attributes that hold the address of a file.
DATA_ATTRIBUTES = ("data-download-url", "data-file-url", "data-url")
REFERENCE = r"(?s)(&#[0-9]{1,8};|&#[xX][0-9a-fA-F]{1,7};|&[A-Za-z][A-Za-z0-9]*;|&|[^&]+)"


def _reference(ref: Column) -> Column:
    """The character of one numeric or named reference; an unknown name stays, an impossible number is U+FFFD.

    Names are those of HTML 4, from Python's own table; numbers 128 to 159 mean the characters of Windows-1252, as in browsers.
    """
    names = F.create_map(*[F.lit(x) for name, code in (name2codepoint | {"apos": 39}).items() for x in (f"&{name};", chr(code))])
    old = F.create_map(*[F.lit(x) for c in range(128, 160) if (own := bytes([c]).decode("cp1252", "ignore")) for x in (c, own)])
    digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    sound = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    # a number that is no character is never decoded
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(ref.startswith("&#"), F.coalesce(F.try_element_at(old, code), plain)).otherwise(F.coalesce(F.try_element_at(names, ref), ref))


def decoded(text: Column) -> Column:
    """Character references of markup as characters, each once; texts without any are left alone."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 1), lambda t: F.when(t.startswith("&"), _reference(t)).otherwise(t))
    return F.when(text.contains("&"), F.replace(F.array_join(parts, ""), F.lit("\u00a0"), F.lit(" "))).otherwise(text)


def _attribute(attributes: Column, *wanted: str) -> Column:
    """Values of the wanted attributes, in order; what looks like one inside another's value is none."""
    groups = [F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), i).alias(n) for i, n in ((1, "n"), (2, "a"), (3, "b"), (4, "c"))]
    named = F.filter(F.arrays_zip(*groups), lambda x: F.lower(x["n"]).isin(*wanted))
    return F.transform(named, lambda x: F.concat(x["a"], x["b"], x["c"]))


def _folded(url: Column) -> Column:
    """``a/./b`` and ``a/x/../b`` of the path as ``a/b``."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    rest = url.substr(F.length(head) + 1, F.length(url))
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done).when(p == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, p)),
    )
    folder = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    folded = F.concat(head, F.array_join(kept, "/"), folder, query)
    return F.when((head != "") & path.rlike(r"(^|/)\.\.?(/|$)"), folded).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link on a page, without its fragment, dot segments folded."""
    site = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_extract(plain, r"^([a-z]+://[^/]+/(?:.*/)?)", 1)
    folder = F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder)
    full = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(plain, href))
        .otherwise(F.concat(folder, href))
    )
    return _folded(F.regexp_replace(full, r"#.*$", ""))


def link_candidates(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Every link of every page once, in page order, with the text it holds, nested elements included; none are cut off."""
    clean = pages.select(key, url, F.regexp_replace(F.col(html), MARKUP, "$2").alias("_html"))
    # one pass finds the links; their parts are told within each
    parts = F.transform(F.regexp_extract_all("_html", F.lit(LINK), 0), lambda t: F.struct(*[F.regexp_extract(t, LINK, i).alias(n) for i, n in ((1, "a"), (2, "inner"), (3, "link"))]))
    text = lambda inner: F.trim(F.regexp_replace(decoded(F.regexp_replace(inner, rf"(?is)</?[a-z]{ATTRIBUTES}>|<[!?/][^>]*>", " ")), r"\s+", " "))
    links = F.transform(parts, lambda p: F.struct(decoded(F.get(_attribute(F.concat(p["a"], p["link"]), "href"), F.lit(0))).alias("href"), text(p["inner"]).alias("text")))
    every = F.when(F.col("_html").rlike("(?i)data-"), F.regexp_extract_all("_html", F.lit(TAG), 1)).otherwise(F.array().cast("array<string>"))
    tags = F.filter(every, lambda t: F.contains(F.lower(t), F.lit("data-")))
    data = F.transform(F.flatten(F.transform(tags, lambda t: _attribute(t, *DATA_ATTRIBUTES))), lambda h: F.struct(decoded(h).alias("href"), F.lit("").alias("text")))
    found = F.filter(F.concat(links, data), lambda c: F.trim(c["href"]) != "")
    spread = clean.select(key, url, F.posexplode(found).alias("pos", "c"))
    full = spread.select(key, F.col(url).alias("page_url"), "pos", resolve(F.col(url), F.trim("c.href")).alias("url"), F.col("c.text").alias("text"))
    return first_per_key(full.where(F.col("url").rlike(r"^https?://")), [key, "url"], [F.col("pos")])


def url_suffix(url: Column) -> Column:
    """Suffix of the path's file name, else of one that a query parameter names."""
    of = lambda text: F.lower(F.regexp_extract(text, r"(\.[A-Za-z0-9]+)$", 1))
    path = of(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", ""))
    named = [F.nullif(of(F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1)), F.lit("")) for p in NAME_PARAMETERS]
    return F.coalesce(F.nullif(path, F.lit("")), *named, F.lit(""))


def judge_links(links: DataFrame, domains: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """Add ``reason`` (null when accepted) and the financial year the link names."""
    from factline.functions.years import fy_from_label

    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    allowed = host.endswith(".gov.au") | (host == "gov.au")
    for d in domains:
        allowed = allowed | (host == d) | host.endswith(f".{d}")
    both = F.concat_ws(" ", "text", "url")
    any_of = lambda patterns: F.greatest(*[both.rlike(f"(?i){p}") for p in patterns], F.lit(False))
    suffix = url_suffix(F.col("url"))
    path = F.lower(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]*", ""))
    strong = F.col("text").rlike(STRONG_PHRASES) | suffix.isin(*DATA_SUFFIXES) | path.contains("download") | path.rlike(r"(^|/)export(/|$)")
    signal = F.col("text").rlike(DOWNLOAD_WORDS) & strong
    reason = F.when(~allowed, "domain_not_allowed")
    if exclude:
        reason = reason.when(any_of(exclude), "excluded_by_registry")
    if include:
        reason = reason.when(~any_of(include), "no_include_pattern_match")
    if suffixes:
        reason = reason.when(~suffix.isin(*suffixes) & ~signal, "format_not_expected")
    return links.withColumn("reason", reason).withColumn("financial_year", fy_from_label(both))


def payload_text(content: Column) -> Column:
    """A payload as text, whatever it is: UTF-8, with or without its mark, UTF-16 with its mark, else a character per byte.

    Nothing is decoded that might be malformed.  UTF-16 is read for its ASCII characters, which are all that types are told by.
    """
    single = F.decode(content, "ISO-8859-1")
    wide = F.replace(F.decode(F.substring(content, 3, 1 << 30), "ISO-8859-1"), F.lit("\0"), F.lit(""))
    own = content.cast("string")
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), wide).when(F.is_valid_utf8(own), F.regexp_replace(own, "^\ufeff", "")).otherwise(single)


def sniff(content: Column) -> Column:
    """Type of a binary payload by its first bytes, else by its text.

    An archive is told by the names in it, which are stored as they are; one without its end is no archive.
    """
    head = F.hex(F.substring(content, 1, 8))
    raw = F.decode(content, "ISO-8859-1")
    text = payload_text(content)
    body = F.regexp_replace(text, r"^\s+", "")
    low = F.lower(F.substring(body, 1, 20))
    html = F.lit(False)
    for mark in HTML_MARKERS:
        html = html | low.startswith(mark)
    archive = F.when(~raw.contains(ARCHIVE_END), "invalid_zip")
    for member, name in OFFICE_MEMBERS:
        archive = archive.when(raw.contains(OFFICE_TYPES) & raw.contains(member), name)
    archive = archive.otherwise("zip")
    kinds = None
    for name, marks in SIGNATURES:
        test = F.lit(False)
        for mark in marks:
            test = test | head.startswith(mark)
        kind = archive if name == "zip" else F.lit(name)
        kinds = F.when(test, kind) if kinds is None else kinds.when(test, kind)
    return (
        kinds.when(html, "html")
        .when(body.startswith("{") | body.startswith("["), "json")
        .when(text.contains("\t"), "tsv")
        .when(text.contains(",") | text.contains("\n"), "csv")
        .otherwise("text")
    )


def validity(detected: Column, content: Column, n_bytes: Column, expected: Sequence[str], least: int = 1, most: int | None = None) -> Column:
    """Why a payload is refused, null when it is fine; the whole payload is searched for challenges."""
    low = F.lower(payload_text(content))
    challenge = F.lit(False)
    for mark in CHALLENGE_MARKERS:
        challenge = challenge | low.contains(mark)
    out = F.when(n_bytes < least, "too_small")
    if most is not None:
        out = out.when(n_bytes > most, "too_large")
    out = out.when(detected == "executable", "executable").when(detected == "text", "unrecognized").when((detected == "html") & challenge, "challenge_page")
    if not {"html", "web"} & set(expected):
        out = out.when(detected == "html", "html_instead_of_data")
    return out

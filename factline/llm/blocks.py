"""HTML to a stream of text blocks with the path of elements each stands in.  A small helper of ``extraction``."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Comments, raw-text elements with their content, tags, declarations, text, and a lone "<".  What the page ends within is cut off.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+)|(?P<less><)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html"}
#: An element of these names ends an open one of the same set when it starts.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that never hold article text.
NOISE = set("nav footer aside form button select option dialog head menu label input".split())
#: Words of class and id names that mark what is not the article.
NOISE_WORDS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer legal login masthead menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies reply share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert form".split())
CONTENT = {"article", "main"}


class Block(NamedTuple):
    path: str
    text: str
    noise: bool
    content: bool
    linked: int


class _Element(NamedTuple):
    name: str
    key: str
    noise: bool
    content: bool


def blocks(page: str | None) -> list[Block]:
    """The non-empty text blocks of a page in order; white space in a block is one blank, character references are decoded."""
    out: list[Block] = []
    stack: list[_Element] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                open_ = [e for e in stack if e.name in BLOCK]
                out.append(Block("/".join(e.key for e in open_), text, any(e.noise for e in stack), any(e.content for e in stack), linked))
        linked = 0

    def close(names: set[str], stop: set[str]) -> None:
        """End the innermost open element of these names, and what is open inside it, unless one of ``stop`` is met first."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                if any(e.name in BLOCK or e.noise for e in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i].name in stop:
                return

    for m in TOKEN.finditer(page or ""):
        if m["text"] or m["less"]:
            raw = html.unescape(m[0])
            parts.append(raw)
            linked += len(raw) if in_link else 0
            continue
        if m["raw"] or not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                in_link = False
            if name in BLOCK:
                flush()
                close({name}, set() if name in ("body", "html", "article", "main") else {"body", "article", "main"} - {name})
            else:
                close({name}, BLOCK)
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in CLOSES_P:
            close({"p"}, (BLOCK - {"p"}) if name == "p" else BLOCK - {"p", "div"})
        if name in SIBLINGS:
            close(SIBLINGS[name], {"ul", "ol", "dl", "table", "select"})
        words, role = [], ""
        if m["attrs"].strip():
            for attr, *values in ATTR.findall(m["attrs"]):
                value = "".join(values).lower()
                if attr.lower() == "role":
                    role = value.strip()
                else:
                    words += re.findall(r"[a-z]+", value)
        in_content = any(e.content for e in stack)
        noise = name in NOISE or role in NOISE_ROLES or not NOISE_WORDS.isdisjoint(words) or (name == "header" and not in_content)
        if noise and name not in BLOCK and name not in NOISE:
            flush()
        if name == "a":
            in_link = True
        stack.append(_Element(name, name + ("." + ".".join(sorted(set(words))) if words else ""), noise and name not in ("body", "html"), (name in CONTENT or role == "main") and not noise))
    flush()
    return out

"""Pages read once, from left to right, by a state machine that takes any markup, however broken.

Tags, comments and raw text are told apart as browsers do: a ``>`` in a quoted attribute ends nothing, what
follows an unclosed script or comment belongs to it, a tag that never ends says nothing.  An end tag closes all
that was opened since its start and is ignored where nothing is open.  Time is linear in the page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestack.scratch import ship

#: Elements without content, elements whose content is no markup, and of these the ones with entities. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
WITH_ENTITIES = frozenset(("title", "textarea"))
#: Elements whose text is not shown. Fixed values.
HIDDEN = frozenset("script style noscript svg iframe noembed noframes".split())
#: Classes of elements that hold a captcha. Fixed values.
CAPTCHAS = frozenset(("g-recaptcha", "h-captcha", "cf-turnstile"))

GAP = r"[ \t\n\r\f]"
VALUE = rf"""{GAP}*+={GAP}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+|)"""
TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]*+[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:{VALUE})?+)*+)([ \t\n\r\f/]*+)>")
ATTRIBUTE = re.compile(rf"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:{GAP}*+={GAP}*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)|))?+""")
COMMENT, COMMENT_END = re.compile("<!--(?:-?>)?"), re.compile("--!?>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.IGNORECASE) for tag in RAW}
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")

TEXTS = pa.list_(pa.string())
#: What can be asked of a page.
FIELDS = {
    "text": (pa.string(), "string"), "title": (pa.string(), "string"), "h1": (pa.string(), "string"), "canonical": (pa.string(), "string"),
    "headings": (pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())])), "array<struct<tag:string,text:string>>"),
    "metas": (pa.list_(pa.struct([(c, pa.string()) for c in ("name", "property", "itemprop", "content")])), "array<struct<name:string,property:string,itemprop:string,content:string>>"),
    "links": (pa.list_(pa.struct([("href", pa.string()), ("anchor", pa.string())])), "array<struct<href:string,anchor:string>>"),
    "jsonld": (TEXTS, "array<string>"), "password": (pa.bool_(), "boolean"), "captcha": (pa.bool_(), "boolean"),
}
#: Elements whose attributes a field needs, and elements whose text it collects.
ATTRIBUTES = {"canonical": "link", "metas": "meta", "links": "a", "jsonld": "script", "password": "input"}
SECTIONS = {"title": ("title",), "h1": ("h1",), "headings": ("h2", "h3"), "links": ("a",), "jsonld": ("script",)}


def squeeze(text: str) -> str:
    return " ".join(text.split())


def attribute_text(value: str) -> str:
    """A value with its entities decoded; ``&copy=`` in a query string is none."""
    def decode(m: re.Match) -> str:
        name = m.group()[1 : len(m.group()) - len(m.group(1))]
        plain = name[0] != "#" and not name.endswith(";")
        return m.group() if plain and (m.group(1) or name not in html5) else unescape("&" + name) + m.group(1)

    return REFERENCE.sub(decode, value) if "&" in value else value


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m.group(1).lower(), attribute_text(m.group(2) or m.group(3) or m.group(4) or ""))
    return found


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """('start', tag, attributes as written, closed at once), ('end', tag, '', False), ('text', element if raw, text, False)."""
    at = begin = 0
    while (lt := page.find("<", at)) >= 0:
        m = TAG.match(page, lt)
        after = page[lt + 1 : lt + 3]
        if m:
            end = m.end()
        elif page.startswith("<!--", lt):
            opening = COMMENT.match(page, lt)
            close = None if opening.group().endswith(">") else COMMENT_END.search(page, lt + 4)
            end = opening.end() if opening.group().endswith(">") else close.end() if close else len(page)
        elif after[:1] in ("!", "?") or (after[:1] == "/" and after[1:] and not (after[1].isascii() and after[1].isalpha())):
            end = page.find(">", lt + 2) + 1 or len(page)
        elif after.lstrip("/")[:1].isascii() and after.lstrip("/")[:1].isalpha():
            end = len(page)  # a tag that never ends
        else:
            at = lt + 1
            continue
        if lt > begin:
            yield "text", "", page[begin:lt], False
        at = begin = end
        if m and m.group(1):
            yield "end", m.group(2).lower(), "", False
        elif m:
            tag, closed = m.group(2).lower(), m.group(4).endswith("/")
            yield "start", tag, m.group(3), closed
            if tag in RAW and not closed:
                close = RAW_END[tag].search(page, at)
                at = begin = close.start() if close else len(page)
                yield "text", tag, page[end:at], False
    if begin < len(page):
        yield "text", "", page[begin:], False


def evidence(page: str, wanted: frozenset[str]) -> dict:
    """The wanted ``FIELDS`` of a page.

    A section, such as a link, ends at its end tag, with the element around it, or where the next of its
    kind begins.  Of several canonical links the last one counts; titles and h1 of a page are joined."""
    look = {ATTRIBUTES[f] for f in wanted if f in ATTRIBUTES}
    collect = {tag for f in wanted for tag in SECTIONS.get(f, ())}
    opened: list[str] = []
    count: Counter[str] = Counter()
    hidden = 0
    shown: list[str] = []
    sections: list[tuple[str, str, list[str]]] = []
    running: dict[str, list[str]] = {}
    metas: list[dict] = []
    canonical, password, captcha = "", False, False
    for kind, tag, source, closed in tokens(page):
        if kind == "text":
            if tag == "script":
                if "script" in running:
                    running["script"].append(source)
                continue
            if hidden:
                continue
            piece = squeeze(source if tag and tag not in WITH_ENTITIES else unescape(source))
            if piece:
                shown.append(piece)
                for parts in running.values():
                    parts.append(piece)
        elif kind == "end":
            if not count[tag]:
                continue
            while True:
                last = opened.pop()
                count[last] -= 1
                hidden -= last in HIDDEN
                running.pop(last, None)
                if last == tag:
                    break
        else:
            has = attributes(source) if tag in look and source else {}
            if tag in collect:
                running.pop(tag, None)
                keep = has.get("href", "").strip() if tag == "a" else "ld+json" in has.get("type", "").lower() if tag == "script" else not hidden
                if keep:
                    sections.append((tag, has.get("href", "").strip(), []))
                    if not closed:
                        running[tag] = sections[-1][2]
            if tag == "meta" and has:
                metas.append({c: has.get(c, "").lower() for c in ("name", "property", "itemprop")} | {"content": squeeze(has.get("content", ""))})
            elif tag == "link" and "canonical" in has.get("rel", "").lower() and has.get("href"):
                canonical = has["href"].strip()
            elif tag == "input" and has.get("type", "").lower() == "password" and count["form"]:
                password = True
            if "captcha" in wanted and not captcha and "class" in source.lower():
                captcha = not CAPTCHAS.isdisjoint(attributes(source).get("class", "").lower().split())
            if not closed and tag not in VOID:
                opened.append(tag)
                count[tag] += 1
                hidden += tag in HIDDEN
    of = lambda name: " ".join(p for tag, _, parts in sections if tag == name for p in parts)
    made = {
        "text": lambda: " ".join(shown), "title": lambda: of("title"), "h1": lambda: of("h1"), "canonical": lambda: canonical, "metas": lambda: metas,
        "headings": lambda: [{"tag": tag, "text": " ".join(parts)} for tag, _, parts in sections if tag in ("h2", "h3")],
        "links": lambda: [{"href": href, "anchor": " ".join(parts)} for tag, href, parts in sections if tag == "a"],
        "jsonld": lambda: ["".join(parts) for tag, _, parts in sections if tag == "script"], "password": lambda: password, "captcha": lambda: captcha,
    }
    return {f: made[f]() for f in wanted}


def page(html: Column, *fields: str, escaped: bool = False) -> Column:
    """Struct of the asked ``FIELDS`` of a page, null for a null one; ``escaped``: its markup may be escaped once."""
    ship(SparkSession.getActiveSession())
    wanted, kind = frozenset(fields), pa.struct([(f, FIELDS[f][0]) for f in fields])

    @F.arrow_udf(f"struct<{','.join(f'{f}:{FIELDS[f][1]}' for f in fields)}>")
    def read(pages: pa.Array) -> pa.Array:
        # one page at a time: a batch of long pages is never held as Python strings
        rows = (p.as_py() for p in pages)
        return pa.array([None if p is None else evidence(unescape(p) if escaped else p, wanted) for p in rows], kind)

    return read(html)

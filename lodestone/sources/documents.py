"""Document parsers: text and LaTeX (native expressions), HTML, JATS and TEI (standard library parsers in pandas UDFs)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, let

PARSED = "struct<title: string, sections: array<struct<title: string, kind: string, text: string>>, equations: array<string>, figures: array<string>, tables: array<string>, refs: array<string>>"
FIELDS = ["title", "sections", "equations", "figures", "tables", "refs"]
# fixed values: tags that begin a line, and those that also end one
STARTS, ENDS = {"p", "div", "section", "br", "li"}, {"p", "div", "section", "li"}


def _tidy(s: str) -> str:
    return " ".join(unescape(s).split())


class _Html(HTMLParser):
    """Text in order, and what stands in headings."""

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.heads: list[str] = []
        self.open: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in STARTS:
            self.out.append("\n")
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.open = (tag, [])

    def handle_endtag(self, tag):
        if self.open and self.open[0] == tag:
            self.heads += [h for h in [_tidy("".join(self.open[1]))] if h]
            self.open = None
        if tag in ENDS:
            self.out.append("\n")

    def handle_data(self, data):
        self.out.append(data)
        if self.open:
            self.open[1].append(data)


def html_text(source: str | None) -> tuple[str | None, str]:
    """The first heading, and the text in which blank lines are at most one."""
    p = _Html()
    p.feed(source or "")
    lines, out, gap = "".join(p.out).split("\n"), [], False
    for i, line in enumerate(lines):
        blank = not line.strip() and 0 < i < len(lines) - 1
        if blank and gap:
            continue
        out.append("" if blank else line)
        gap = blank
    return (p.heads[0] if p.heads else None), "\n".join(out).strip()


def _name(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _flat(e) -> str:
    return _tidy(" ".join(e.itertext()))


def _told(elements: Iterable, inside: str) -> list[str]:
    """What the first descendant of that name says, for each element; empty without one."""
    return [next((_flat(c) for c in e.iter() if _name(c) == inside), "") for e in elements]


def _document(source: str | None, kind: str, head: str, body: set[str], keep_empty: bool, refs: set[str]):
    """(all elements, document) with sections in order, each the text of its direct body children; null if the XML doesn't parse."""
    try:
        root = ElementTree.fromstring(source or "")
    except ElementTree.ParseError:
        return None
    every = list(root.iter())
    sections = []
    for e in every:
        if _name(e) == kind:
            title = next((_flat(c) for c in e if _name(c) == head), None)
            text = "\n\n".join(t for t in (_flat(c) for c in e if _name(c) in body) if t)
            if keep_empty or text or title:
                sections.append({"title": title, "kind": kind, "text": text})
    sections = sections or [{"title": None, "kind": "body", "text": _flat(root)}]
    return every, {"title": sections[0]["title"], "sections": sections, "equations": [], "figures": [], "tables": [], "refs": [t for t in (_flat(e) for e in every if _name(e) in refs) if t]}


def jats_document(source: str | None) -> dict | None:
    found = _document(source, "sec", "title", {"p", "statement", "disp-quote"}, False, {"ref"})
    if found is None:
        return None
    every, d = found
    for e in every:
        if _name(e) in {"disp-formula", "inline-formula"}:
            tex = next((c for c in e.iter() if _name(c) in {"tex-math", "alternatives"}), None)
            math = next((c for c in e.iter() if _name(c) == "math"), None)
            d["equations"].append(_flat(tex) if tex is not None else ElementTree.tostring(math, encoding="unicode") if math is not None else "")
    d["figures"] = _told((e for e in every if _name(e) == "fig"), "caption")
    d["tables"] = _told((e for e in every if _name(e) == "table-wrap"), "caption")
    return d


def tei_document(source: str | None) -> dict | None:
    found = _document(source, "div", "head", {"p", "ab"}, True, {"bibl", "biblStruct"})
    return found and found[1]


def html_document(source: str | None) -> dict:
    title, text = html_text(source)
    return {"title": title, "sections": [{"title": title, "kind": "body", "text": text}], "equations": [], "figures": [], "tables": [], "refs": []}


def _udf(one: Callable[[str | None], dict | None]) -> Callable:
    @F.pandas_udf(PARSED)
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = [one(x) or {"title": None} | {k: [] for k in FIELDS[1:]} for x in s]
        return pd.DataFrame(rows, columns=FIELDS)

    return parse


def html(c: Column) -> Column:
    return _udf(html_document)(c)


def jats(c: Column) -> Column:
    return _udf(jats_document)(c)


def tei(c: Column) -> Column:
    return _udf(tei_document)(c)


def _parsed(title: Column, sections: Column, equations: Column, refs: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(title.alias("title"), sections.alias("sections"), equations.alias("equations"), none.alias("figures"), none.alias("tables"), refs.alias("refs"))


def _section(title: Column, kind: Column, text: Column) -> Column:
    return F.struct(title.cast("string").alias("title"), kind.alias("kind"), text.alias("text"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text(c: Column) -> Column:
    none = F.array().cast("array<string>")
    return _parsed(F.lit(None).cast("string"), F.array(_section(F.lit(None), F.lit("body"), _stripped(c))), none, none)


def latex(c: Column) -> Column:
    """Sections after each section command (the whole text if there is none), equations of environments and then displayed ones, bibliography items."""
    command = r"\\(section|subsection|subsubsection)\*?\{([^}]*)\}"
    named = lambda g: F.regexp_extract_all(c, F.lit(command), F.lit(g))
    pieces = F.arrays_zip(named(1).alias("kind"), named(2).alias("title"), F.slice(F.split(c, command, -1), F.lit(2), F.greatest(F.size(named(1)), F.lit(1))).alias("text"))
    cut = let(pieces, lambda p: F.transform(p, lambda s: _section(collapse(s["title"]), s["kind"], _stripped(s["text"]))))
    sections = F.when(F.size(named(1)) > 0, cut).otherwise(F.array(_section(F.lit(None), F.lit("body"), _stripped(c))))
    inside = F.regexp_extract_all(c, F.lit(r"(?s)\\begin\{(equation\*?|align\*?|gather\*?)\}(.*?)\\end\{\1\}"), F.lit(2))
    shown = F.regexp_extract_all(c, F.lit(r"(?s)\\\[(.*?)\\\]"), F.lit(1))
    items = F.regexp_extract_all(c, F.lit(r"(?s)\\bibitem(?:\[[^\]]*\])?\{[^}]+\}(.*?)(?=\\bibitem|\\end\{thebibliography\}|\z)"), F.lit(1))
    title = F.when(F.size(named(1)) > 0, collapse(F.get(named(2), 0)))
    return _parsed(title, sections, F.transform(F.concat(inside, shown), _stripped), F.filter(F.transform(items, collapse), lambda r: r != ""))


PARSERS: dict[str, Callable[[Column], Column]] = {"text": text, "html": html, "jats": jats, "tei": tei, "latex": latex, "tex": latex}


def register(name: str, parser_: Callable[[Column], Column]) -> None:
    """A later registration of a name takes its place."""
    PARSERS[name.lower()] = parser_


def parser(name: str) -> Callable[[Column], Column]:
    """By case-insensitive name; KeyError if there is none."""
    return PARSERS[name.lower()]

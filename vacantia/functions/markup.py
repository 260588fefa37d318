"""HTML in the core: plain text of fragments, structured data, class-marked cards. Standard library only, as Arrow functions."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
NO_TEXT = {"script", "style", "template", "noscript"}
#: Elements that go before the whole body is taken.
GONE = {"script", "style", "noscript", "svg", "canvas", "iframe"}
MAX_PAGE_CHARS = 60_000
# How pages write one country.
ISRAEL = {"il", "israel", "isr"}


class Element:
    """A node of a small tree: tag, attributes, children (elements and texts), parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def texts(self, hidden: bool = False) -> list[str]:
        """The texts below, each stripped, blank ones left out."""
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                if e.strip():
                    out.append(" ".join(e.split()))
            elif hidden or e.tag not in NO_TEXT:
                stack.extend(reversed(e.children))
        return out

    def text(self, between: str = " ") -> str:
        return between.join(self.texts())

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def having(self, *names: str) -> list[Element]:
        return [e for e in self.walk() if e.classes() & set(names)]


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(source: str) -> Element:
    t = _Tree()
    t.feed(source)
    t.close()
    return t.root


def plain(value: str | None) -> str:
    """Text of a fragment: tags go only where both brackets occur, then entities too; white space collapsed."""
    text = value or ""
    if "<" in text and ">" in text:
        text = tree(text).text()
    return " ".join(text.split())


@F.pandas_udf(T.StringType())
def plain_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([plain(v) for v in s], dtype=object)


def typed_nodes(data, kind: str) -> Iterator[dict]:
    """All objects of a type in nested structured data; the case of the type doesn't count."""
    kind, stack = kind.casefold(), [data]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            types = x.get("@type")
            if kind in (str(t).casefold() for t in (types if isinstance(types, list) else [types])):
                yield x
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def structured(source: str) -> list:
    """Every readable JSON-LD script of a page."""
    out = []
    for e in tree(source).walk():
        if e.tag == "script" and e.attrs.get("type", "").lower() == "application/ld+json":
            try:
                out.append(json.loads("".join(c for c in e.children if isinstance(c, str))))
            except ValueError:
                continue
    return out


def lines_text(text: str) -> str:
    """White space within lines collapsed; blank lines and lines equal to the one before dropped."""
    out: list[str] = []
    for line in text.replace("\u00a0", " ").replace("\r\n", "\n").replace("\r", "\n").splitlines():
        line = re.sub(r"[ \t]+", " ", line).strip()
        if line and (not out or out[-1] != line):
            out.append(line)
    return "\n".join(out)[:MAX_PAGE_CHARS]


def fragment_text(value) -> str:
    """Text of a JSON value: lists by element, objects by their name, description and value, all else as markup."""
    if value is None:
        return ""
    if isinstance(value, list):
        parts = [fragment_text(x) for x in value]
    elif isinstance(value, dict):
        parts = [fragment_text(value[k]) for k in ("name", "description", "value") if k in value]
    else:
        text = str(value)
        parts = [tree(text).text("\n") if "<" in text else html.unescape(text)]
    return lines_text("\n".join(p for p in parts if p))


def place_text(value) -> str:
    """A place given as text, object or list: the parts of its address, else its name."""
    if isinstance(value, list):
        return lines_text(", ".join(p for p in map(place_text, value) if p))
    if isinstance(value, dict):
        address = value.get("address")
        if isinstance(address, dict):
            return lines_text(", ".join(str(address[k]) for k in ("streetAddress", "addressLocality", "addressRegion", "addressCountry") if address.get(k)))
        return next((lines_text(str(value[k])) for k in ("name", "addressLocality", "addressRegion", "addressCountry") if value.get(k)), "")
    return lines_text(value) if isinstance(value, str) else ""


PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("page_title", "company", "location", "description_text", "extractor")])
LEAST_DESCRIPTION = 200
MOST_PLACE = 200


def _holds(e: Element, attribute: str, *parts: str) -> bool:
    return any(p in (e.attrs.get(attribute) or "") for p in parts)


def _describes(e: Element) -> bool:
    """Whether an element is likely to hold the description: by its type, part of a class or id, class, id or tag."""
    return (
        _holds(e, "itemtype", "JobPosting") or _holds(e, "class", "job-description", "job_description") or _holds(e, "id", "job-description", "job_description")
        or bool(e.classes() & {"job-details", "job__description", "description"}) or e.attrs.get("id") == "content" or e.tag in ("main", "article")
    )


def _inside(e: Element, *tags: str) -> bool:
    while e.parent is not None:
        e = e.parent
        if e.tag in tags:
            return True
    return False


PLACE_MARKS = (
    lambda e: e.attrs.get("itemprop") == "jobLocation", lambda e: _holds(e, "class", "job-location"), lambda e: _holds(e, "class", "job_location"),
    lambda e: "location" in e.classes() and _inside(e, "main"), lambda e: "location" in e.classes() and _inside(e, "article"),
)


def _host(url) -> str:
    try:
        return (urlsplit(str(url or "").strip()).hostname or "").casefold()
    except ValueError:
        return ""


def page_metadata(root: Element, data: list, url: str | None) -> tuple[str | None, str | None]:
    """Company and place of a page: of its postings, else the organisation of the page's host and marked elements."""
    company = location = None
    for job in (j for d in data for j in typed_nodes(d, "JobPosting")):
        employer = job.get("hiringOrganization")
        employer = employer.get("name") if isinstance(employer, dict) else employer if isinstance(employer, str) else None
        company = lines_text(str(employer or "")) or company
        location = place_text(job.get("jobLocation") or job.get("applicantLocationRequirements")) or location
        if not location and "telecommute" in lines_text(str(job.get("jobLocationType") or "")).casefold():
            location = "Remote"
        if company and location:
            break
    if not company and _host(url):
        same = (o for d in data for o in typed_nodes(d, "Organization") if _host(o.get("url")) == _host(url))
        company = next((n for o in same if (n := lines_text(str(o.get("name") or "")))), None)
    if not location:
        for mark in PLACE_MARKS:
            e = next((e for e in root.walk() if mark(e)), None)
            if e is not None and (text := lines_text(e.text())) and len(text) <= MOST_PLACE:
                location = text
                break
    return company, location


def page_description(root: Element, data: list) -> tuple[str | None, str | None, str | None]:
    """Title of the structured posting, description, and where the description comes from."""
    found = []
    for job in (j for d in data for j in typed_nodes(d, "JobPosting")):
        parts = [fragment_text(job.get(k)) for k in ("description", "responsibilities", "qualifications", "skills", "experienceRequirements", "educationRequirements")]
        found.append((fragment_text(job.get("title") or job.get("name")), lines_text("\n\n".join(p for p in parts if p))))
    title, text = max(found, key=lambda f: len(f[1]), default=("", ""))
    if len(text) >= LEAST_DESCRIPTION:
        return title or None, text, "json-ld"
    likely = [t for e in root.walk() if _describes(e) and len(t := lines_text(e.text("\n"))) >= LEAST_DESCRIPTION]
    if likely:
        return title or None, max(likely, key=len), "html-fallback"
    for e in root.walk():
        e.children = [c for c in e.children if isinstance(c, str) or c.tag not in GONE]
    body = next((e for e in root.walk() if e.tag == "body"), None)
    text = lines_text(body.text("\n")) if body is not None else ""
    return title or None, text if len(text) >= LEAST_DESCRIPTION else None, "html-fallback"


def page_fields(source: str, url: str | None = None) -> tuple:
    """Title, company, place and description of a page, and where the description comes from."""
    root, data = tree(source), structured(source)
    title = next((t for e in root.walk() if e.tag == "title" and (t := lines_text(e.text()))), None) or next((t for e in root.walk() if e.tag == "h1" and (t := lines_text(e.text()))), None)
    company, location = page_metadata(root, data, url)
    own_title, text, extractor = page_description(root, data)
    return own_title or title, company, location, text, extractor


@F.pandas_udf(PAGE)
def page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The fields of each page (source, address)."""
    names = PAGE.fieldNames()
    for sources, urls in batches:
        yield pd.DataFrame([page_fields(v, u) if isinstance(v, str) else (None,) * len(names) for v, u in zip(sources, urls)], columns=names)


JOB_PAGE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("source_job_id", "title", "location", "posted_on", "description_text", "reason")), T.StructField("country_codes", T.ArrayType(T.StringType()))])


def job_page_fields(source: str) -> tuple:
    """The first structured posting of a job's own page; a reason instead where there is none or it lacks a field."""
    job = next((d for d in structured(source) if isinstance(d, dict) and d.get("@type") == "JobPosting"), None)
    if job is None:
        return (*(None,) * 5, "no posting data", None)
    ident = job.get("identifier")
    ident = str(ident.get("value", "") if isinstance(ident, dict) else ident or "").strip()
    raw = job.get("jobLocation", [])
    places, codes = [], set()
    for entry in [raw] if isinstance(raw, dict) else raw if isinstance(raw, list) else []:
        address = entry.get("address") if isinstance(entry, dict) else None
        if isinstance(address, dict):
            parts = [plain(address.get(k)) if isinstance(address.get(k), str) else "" for k in ("addressLocality", "addressRegion", "addressCountry")]
            places.append(", ".join(p for p in parts if p))
            if parts[2].casefold() in ISRAEL:
                codes.add("IL")
    place, title = "; ".join(dict.fromkeys(p for p in places if p)), plain(str(job.get("title") or ""))
    if not (ident and title and place):
        return (*(None,) * 5, "incomplete posting data", None)
    return ident, title, place, str(job.get("datePosted") or "")[:10] or None, plain(str(job.get("description") or "")), None, sorted(codes)


@F.pandas_udf(JOB_PAGE)
def job_page(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = JOB_PAGE.fieldNames()
    for s in batches:
        yield pd.DataFrame([job_page_fields(v) if isinstance(v, str) else (*(None,) * 5, "no page", None) for v in s], columns=names)


def unescaped(text: str) -> str:
    return " ".join(html.unescape(text).split())


def attribute_id(url: str, pattern: str) -> str | None:
    m = re.search(pattern, html.unescape(url).strip())
    return m[1] if m else None

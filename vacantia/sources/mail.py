"""Job cards in e-mails, in pages and in pasted text: payloads to normalised jobs.

MIME, card markup and free layouts have no native form, so they are parsed by Arrow functions: one payload in, an array
of cards out. A payload that can't be read gives a reason instead of cards and never stops the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser
from email.utils import parseaddr, parsedate_to_datetime
from datetime import timezone
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import schemas
from vacantia.functions.text import PHONE
from vacantia.functions.markup import Element, plain, tree, unescaped

MOST_BYTES = 5 * 1024 * 1024
MOST_TEXT = 250_000
MOST_CARD = 8_000
CARDS = T.StructType([
    T.StructField("message_date", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("skipped", T.IntegerType()),
    T.StructField("cards", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("job_id", "title", "company", "location", "posted_on", "job_url", "raw_text")]))),
])
# Senders, marks of cards, and forms of lines of two senders of job e-mails.
NETWORK_SENDERS = {"jobs-noreply@linkedin.com", "jobalerts-noreply@linkedin.com", "jobs-listings@linkedin.com"}
NETWORK_TITLE = {"text-color-brand", "text-system-blue-50"}
NETWORK_META = "text-system-gray-100"
NETWORK_JOB = re.compile(r"^/(?:comm/)?jobs/view/(\d+)/?$", re.I)
STORE_SENDER, STORE_SUBJECT = "noreply@mail.amazon.jobs", "recommended amazon jobs for "
STORE_JOB = re.compile(r"https?://(?:www\.)?amazon\.jobs/(?:(?:[a-z]{2}(?:-[a-z]{2})?)/)?jobs/(\d+)", re.I)
JOB_ID_LINE = re.compile(r"\bjob\s*id\s*[:#-]?\s*(\d{5,12})\b", re.I)
PLACE_NAMES = ("EXL", "Exampleland", "ISR", "Israel", "USA", "United States", "United Kingdom", "UK", "Canada", "Germany", "India", "Ireland", "Spain", "France", "Italy", "Poland", "Romania", "Japan", "Australia")
OTHER_PLACES = r"\+\d+\s+other locations?"
LABS, LABS_COMPANY = "Annapurna Labs", "Annapurna Labs Ltd."
NO_CARD_LINES = {"|", "read more", "apply now", "view job", "view jobs", "view all", "view all recommendations", "basic qualifications", "preferred qualifications", "sort by", "most relevant", "most recent"}
FOOTERS = ("amazon is an equal opportunity employer", "equal opportunity", "join us on", "privacy and data", "career areas", "working at amazon")
PLACE_LINE = re.compile("|".join([*(rf"\b{n}\b" for n in PLACE_NAMES), OTHER_PLACES]), re.I)
CONTACT = (re.compile(r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I), re.compile(r"https?://\S+", re.I), re.compile(PHONE))


def decoded(messages: DataFrame, column: str = "raw", most: int = MOST_BYTES) -> DataFrame:
    """``messages`` with ``content``, the bytes of a web-safe base64 text, and ``reason`` where there are none: no content,
    invalid, or too large."""
    text = F.regexp_replace(F.translate(F.coalesce(F.col(column), F.lit("")), "-_", "+/"), "=+$", "")
    valid = text.rlike("^[A-Za-z0-9+/]+$") & (F.length(text) % 4 != 1)
    size = F.floor(F.length(text) * 3 / 4)
    content = F.when(valid & (size <= most), F.unbase64(F.concat(text, F.expr("repeat('=', int(pmod(-length(regexp_replace(" + f"coalesce({column}, ''), '=+$', '')), 4)))"))))
    reason = F.when(text == "", "no content").when(~valid, "invalid content").when(size > most, "too large")
    return messages.withColumns({"content": content, "reason": reason})


MOST_DAYS, MOST_MESSAGES = 90, 50


def recent(messages: DataFrame, received: str, now: Column, days: int = 14, most: int = 20) -> DataFrame:
    """The newest messages of the last days, as a mailbox search gives them."""
    if not 1 <= days <= MOST_DAYS:
        raise ValueError(f"days must be 1 to {MOST_DAYS}")
    if not 1 <= most <= MOST_MESSAGES:
        raise ValueError(f"most must be 1 to {MOST_MESSAGES}")
    return messages.filter((F.col(received) <= now) & (F.col(received) > now - F.expr(f"interval {days} days"))).orderBy(F.desc(received), *messages.columns).limit(most)


def mail(raw: bytes, sender: Callable[[str], bool], subject: str = "") -> tuple[str | None, str]:
    """Date and HTML body of a message from an accepted sender; raises ValueError with the reason otherwise."""
    if not raw or len(raw) > MOST_BYTES:
        raise ValueError("empty or too large")
    m = BytesParser(policy=policy.default).parsebytes(raw)
    if not sender(parseaddr(m.get("From", ""))[1].casefold()):
        raise ValueError("another sender")
    if not str(m.get("Subject", "")).casefold().startswith(subject):
        raise ValueError("another subject")
    body = m.get_body(preferencelist=("html",))
    content = body.get_content() if body is not None else ""
    if not isinstance(content, str) or not content.strip():
        raise ValueError("no HTML body")
    try:
        date = parsedate_to_datetime(m.get("Date"))
        when = (date if date.tzinfo else date.replace(tzinfo=timezone.utc)).isoformat()
    except (TypeError, ValueError):
        when = None
    return when, content


def network_cards(content: str) -> tuple[list[tuple], int]:
    """Cards with a marked title link and a ``company · place`` paragraph in the same table, each job once."""
    out, skipped = {}, 0
    for a in tree(content).walk():
        if a.tag != "a" or not a.classes() & NETWORK_TITLE:
            continue
        parts = urlsplit(a.attrs.get("href", "").strip())
        hit = NETWORK_JOB.match(parts.path) if (parts.hostname or "").rstrip(".") in {"linkedin.com", "www.linkedin.com"} else None
        if not hit or hit[1] in out:
            continue
        table = a.parent
        while table is not None and table.tag != "table":
            table = table.parent
        meta = next((p.text() for p in table.walk() if p.tag == "p" and NETWORK_META in p.classes()), "") if table else ""
        company, dot, place = (unescaped(x) for x in meta.partition("·"))
        title = unescaped(a.text())
        if not (title and dot and company and place):
            skipped += 1
            continue
        url = f"https://www.linkedin.com/jobs/view/{hit[1]}"
        out[hit[1]] = (hit[1], title, company, place, None, url, "\n".join((title, company, place)))
    return list(out.values()), skipped


def store_job_id(href: str) -> str | None:
    """The job behind a link, which may be tracked and so encoded twice."""
    url = href.strip()
    host = (urlsplit(url).hostname or "").rstrip(".")
    if host not in {"amazon.jobs", "www.amazon.jobs"} and not host.endswith(".awstrack.me"):
        return None
    for _ in range(3):
        if m := STORE_JOB.search(url):
            return m[1]
        url = unquote(url)
    return None


def solid_lines(text: str) -> list[str]:
    """Lines without contacts and bullets, none blank or equal to the one before."""
    out: list[str] = []
    for line in text.splitlines():
        line = unescaped(line)
        for k, p in enumerate(CONTACT):
            if k < 2 or not JOB_ID_LINE.search(line):
                line = p.sub(" ", line)
        line = " ".join(re.sub(r"^\s*[•●▪*-]\s+", "", line).split())
        if line and (not out or out[-1] != line):
            out.append(line)
    return out


def _card(job_id: str, title: str, place: str | None, lines: list[str]) -> tuple:
    named = re.search(rf"\b{LABS}\b", "\n".join(lines), re.I)
    company = LABS_COMPANY if named else next((x[:300] for x in lines if re.search(r"\bAmazon\b.*\b(?:Ltd\.?|LLC|Inc\.?)", x, re.I)), "Amazon")
    kept: list[str] = []
    for x in lines:
        if x.casefold().startswith(FOOTERS):
            break
        if x.casefold() not in NO_CARD_LINES:
            kept.append(x)
    return job_id, title, company, place, None, f"https://www.amazon.jobs/jobs/{job_id}", "\n".join(kept)[:MOST_CARD]


def store_cards(content: str) -> tuple[list[tuple], int]:
    """Cards around links to jobs: the largest element that holds links to one job only."""
    root, out = tree(content), {}
    ids = {id(a): j for a in root.walk() if a.tag == "a" and (j := store_job_id(a.attrs.get("href", "")))}
    skipped = 0
    for a in root.walk():
        job = ids.get(id(a))
        title = unescaped(a.text())
        if not job or job in out or not title or title.casefold() in NO_CARD_LINES:
            continue
        box: Element = a
        while box.parent is not None and {ids[id(x)] for x in box.parent.walk() if id(x) in ids} == {job}:
            box = box.parent
        lines = solid_lines(box.text("\n"))
        at = lines.index(title) if title in lines else -1
        place = next((x[:300] for x in lines[at + 1 : at + 8] if x.casefold() not in NO_CARD_LINES and not JOB_ID_LINE.search(x) and not x.casefold().startswith("posted ") and PLACE_LINE.search(x)), None)
        out[job] = _card(job, title, place, lines)
    return list(out.values()), skipped


def pasted_cards(text: str) -> tuple[list[tuple], int]:
    """Cards of pasted text: before each job-id line, within twelve lines, the place and above it the title; a card ends
    where the next title begins."""
    if len(text) > MOST_TEXT:
        raise ValueError("too long")
    lines = solid_lines(text)
    rows = []
    for at, line in enumerate(lines):
        if not (m := JOB_ID_LINE.search(line)):
            continue
        low = max(0, at - 12)
        place = next((k for k in range(at - 1, low - 1, -1) if PLACE_LINE.search(lines[k])), None)
        top = at if place is None else place
        title = next((k for k in range(top - 1, low - 1, -1) if _titled(lines[k])), None)
        if title is not None:
            rows.append((title, m[1], lines[title], None if place is None else lines[place]))
    out = {}
    for k, (at, job, title, place) in enumerate(rows):
        if job not in out:
            out[job] = _card(job, title, place, lines[at : rows[k + 1][0] if k + 1 < len(rows) else len(lines)])
    if not out:
        raise ValueError("no cards")
    return list(out.values()), 0


def _titled(line: str) -> bool:
    low = line.casefold()
    return 3 <= len(line) <= 500 and low not in NO_CARD_LINES and not JOB_ID_LINE.search(line) and not low.startswith(("posted ", "updated ")) and not PLACE_LINE.fullmatch(line) and not set(line) <= set("|•-–—")


def page_cards(card: str, title: str, place: str, date: str, link: str, text: str, host: str, path: str):
    """A parser of pages whose cards are marked by classes; the id is the group of ``path`` in the link's path."""

    def parse(content: str) -> tuple[list[tuple], int]:
        out, skipped = {}, 0
        for box in tree(content).having(card):
            first = lambda mark: next(iter(box.having(mark)), None)
            t, p, d, x = (first(m) for m in (title, place, date, text))
            a = next((e for e in box.having(link) if e.tag == "a" and e.attrs.get("href")), None)
            url = urlsplit(a.attrs["href"].strip()) if a else None
            hit = re.fullmatch(path, url.path) if url and url.scheme == "https" and url.netloc == host else None
            if not (t and p and hit and t.text() and p.text()):
                skipped += 1
                continue
            if hit[1] not in out:
                out[hit[1]] = (hit[1], plain(t.text()), None, plain(p.text()), d.text()[:10] if d else None, f"https://{host}{url.path.rstrip('/')}", plain(x.text() if x else t.text()))
        if not out:
            raise ValueError("no cards")
        return list(out.values()), skipped

    return parse


def _reader(parse: Callable) -> Callable:
    @F.pandas_udf(CARDS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = CARDS["cards"].dataType.elementType.fieldNames()
        for s in batches:
            rows = []
            for v in s:
                try:
                    date, (cards, skipped) = parse(v)
                    rows.append((date, None if cards else "no cards", skipped, [dict(zip(names, c)) for c in cards]))
                except (ValueError, LookupError, AttributeError, TypeError) as e:
                    rows.append((None, str(e)[:200] or "unreadable", 0, []))
            yield pd.DataFrame(rows, columns=CARDS.fieldNames())

    return read


def _network_mail(raw: bytes):
    date, content = mail(bytes(raw), NETWORK_SENDERS.__contains__)
    return date, network_cards(content)


def _store_mail(raw: bytes):
    date, content = mail(bytes(raw), STORE_SENDER.__eq__, STORE_SUBJECT)
    return date, store_cards(content)


def read_cards(payloads: DataFrame, kind: str, column: str = "content") -> DataFrame:
    """``payloads`` with message_date, reason, skipped and cards; kinds: ``network_mail``, ``store_mail``, ``pasted``."""
    parse = {"network_mail": _network_mail, "store_mail": _store_mail, "pasted": lambda v: (None, pasted_cards(v))}[kind]
    return payloads.withColumn("__r", _reader(parse)(column)).select("*", "__r.*").drop("__r")


def read_page_cards(payloads: DataFrame, parser: Callable, column: str = "payload") -> DataFrame:
    return payloads.withColumn("__r", _reader(lambda v: (None, parser(v)))(column)).select("*", "__r.*").drop("__r")


def to_jobs(df: DataFrame, source: str, group: str, confidence: float, order: str = "path") -> DataFrame:
    """The cards as normalised jobs; of a job in several payloads the first counts."""
    rows = df.select(F.col(order).alias("__o"), "message_date", F.posexplode("cards").alias("__n", "c"))
    rows = rows.groupBy("c.job_id").agg(F.min_by(F.struct("c", "message_date"), F.struct("__o", "__n")).alias("m"))
    c = F.col("m.c")
    return schemas.jobs(rows, source=F.lit(source), source_group=F.lit(group), source_message_id=c["job_id"], source_message_url=c["job_url"], message_date=F.col("m.message_date"), title=c["title"], company=c["company"], location=c["location"], posted_on=c["posted_on"], job_url=c["job_url"], raw_text=c["raw_text"], parse_confidence=F.lit(confidence))

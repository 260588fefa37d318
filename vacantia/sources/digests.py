"""Digest messages of channels and groups to normalised jobs, and the registry that finds the parser of a message."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import schemas
from vacantia.functions import text as t

NOTIFICATION_ID = "wa_notification_"
TITLE = r"^\*(.+)\*$"
LEVEL = "📈"
ALTERNATE_HEADER = "🔥 New position 🔥"
# Words by which the preview of a notification is taken for a title.
PREVIEW_TITLE = r"(?iU)\b(?:developer|engineer|programmer|software|backend|front[\s-]?end|full[\s-]?stack|devops|qa|algorithm|embedded|data\s+analyst)\b|מפתח(?:ת)?|מהנדס(?:ת)?|מתכנת(?:ת)?|פיתוח|תוכנה|בדיקות"
MOST_TITLE = 256


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def _hundredths(*parts: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for there, n in parts:
        total = total + F.when(there, n).otherwise(0)
    return total / 100


def _urls(column: str = "urls") -> Column:
    clean = F.transform(F.coalesce(column, F.array().cast("array<string>")), t.normalize_url)
    return F.array_distinct(F.filter(clean, lambda u: u != ""))


def channel_digest(messages: DataFrame) -> DataFrame:
    """``Title @ Company`` in the first line, then ``Posted on:`` and ``Location:`` lines; blank messages give nothing."""
    rows = messages.withColumn("__l", _lines(F.col("raw_text"))).filter(F.size("__l") > 0)
    title, company = t.split_title_and_company(F.element_at("__l", 1))
    rest = F.slice("__l", 2, 1_000_000)
    rows = rows.withColumns({"__t": F.nullif(title, F.lit("")), "__c": company, "__p": t.posted_date(t.labelled(rest, "posted on")).cast("string"), "__o": t.labelled(rest, "location"), "__u": F.try_element_at(_urls(), F.lit(1))})
    there = lambda c: F.col(c).isNotNull()
    score = _hundredths((there("__t"), 30), (there("__c"), 20), (there("__o"), 15), (there("__p"), 10), (there("__u"), 25))
    c = F.col
    return schemas.jobs(rows, source=c("source"), source_group=c("source_group"), source_message_id=c("source_message_id"), source_message_url=c("source_message_url"), message_date=c("message_date"), title=c("__t"), company=c("__c"), location=c("__o"), posted_on=c("__p"), job_url=c("__u"), raw_text=F.trim("raw_text"), parse_confidence=score)


def channel_shape(messages: DataFrame) -> DataFrame:
    """The messages in the shape of an exported job: title and company in the first line, both labelled lines, a link."""
    lines = _lines(F.col("raw_text"))
    later = lambda label: F.exists(F.slice(lines, 2, 1_000_000), lambda x: F.lower(x).startswith(label))
    shaped = F.coalesce(F.try_element_at(lines, F.lit(1)).contains(" @ "), F.lit(False)) & later("posted on:") & later("location:")
    return messages.filter(shaped & (F.size(F.coalesce("urls", F.array().cast("array<string>"))) > 0))


def live_urls(entities: Column, text: Column, buttons: Column, preview: Column) -> Column:
    """The addresses of a live message, normalised, each once: of its entities (structs of type, text, href), its text, its
    rows of buttons (arrays of arrays of addresses) and its link preview."""
    none = F.array().cast("array<string>")
    linked = F.transform(entities, lambda e: F.when(e["type"] == "text_link", e["href"]).when(e["type"] == "url", e["text"]))
    every = F.concat(F.coalesce(linked, none), t.visible_urls(text), F.coalesce(F.flatten(F.filter(buttons, lambda r: r.isNotNull())), none), F.array(preview))
    return F.array_distinct(F.filter(F.transform(F.array_compact(every), t.normalize_url), lambda u: u != ""))


def allowed_url(urls: Column, host: str, path: str) -> Column:
    """The first address of exactly this host whose path matches as a whole."""
    of = lambda u, k: F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]*)([^?#]*)", k)
    return F.try_element_at(F.filter(F.transform(urls, t.normalize_url), lambda u: (F.lower(of(u, 1)) == host.lower()) & of(u, 2).rlike(f"^(?:{path})$")), F.lit(1))


def notification_id(application: Column, group: Column, number: Column, created: Column) -> Column:
    """The id of a notification: a hash of application, group, number and time."""
    return F.concat(F.lit(NOTIFICATION_ID), t.sha(F.concat_ws("\n", application, group, number.cast("string"), created)))


def preview(messages: DataFrame, parser: Callable[[DataFrame], DataFrame], most: int = 5, order: str = "source_message_id") -> tuple[DataFrame, DataFrame]:
    """A dry run: (checked, parsed) and the first parsed jobs; nothing is written."""
    if most < 0:
        raise ValueError("most must not be negative")
    parsed = parser(messages)
    both = messages.select(F.lit(1).alias("c"), F.lit(0).alias("p")).unionAll(parsed.select(F.lit(0), F.lit(1)))
    counts = both.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("checked"), F.coalesce(F.sum("p"), F.lit(0)).alias("parsed"))
    return counts, parsed.orderBy(order, "title").limit(most).select("title", "company", "location", "posted_on", "job_url")


def preview_title(line: Column) -> Column:
    """A title shown by a notification: no link, not too long, with a word of the trade; stars around it go."""
    bare = F.trim(F.regexp_replace(F.trim(line), r"^\*(.*)\*$", "$1"))
    return F.when((bare != "") & (F.length(bare) <= MOST_TITLE) & ~bare.contains("://") & bare.rlike(PREVIEW_TITLE), bare)


def group_digest(messages: DataFrame, host: str | None = None, path: str = ".*") -> DataFrame:
    """``*Title*`` with a level line, or the alternate header and the title below it, each with a job's address (of a host and
    below a path, if given); of notifications also a lone title. Messages without sender, and those in neither form, give nothing."""
    rows = messages.filter(F.col("sender").isNotNull()).withColumn("__l", _lines(F.col("raw_text"))).filter(F.size("__l") > 0)
    first_url = F.try_element_at(_urls(), F.lit(1)) if host is None else allowed_url(F.coalesce("urls", F.array().cast("array<string>")), host, path)
    first, noted = F.element_at("__l", 1), F.col("source_message_id").startswith(NOTIFICATION_ID)
    level = F.exists(F.slice("__l", 2, 1_000_000), lambda x: x.startswith(LEVEL))
    starred = F.nullif(F.trim(F.regexp_extract(first, TITLE, 1)), F.lit(""))
    title = (
        F.when(F.col("__u").isNull(), F.when(noted & (F.size("__l") == 1), preview_title(first)))
        .when(first.rlike(TITLE), F.when(level, starred))
        .when((first == ALTERNATE_HEADER) & (F.size("__l") >= 2), F.try_element_at("__l", F.lit(2)))
        .when(noted & level, preview_title(first))
    )
    rows = rows.withColumn("__u", first_url)
    rows = rows.withColumns({"__t": title, "__v": level, "__p": F.when(F.array_contains("__l", "Posted today") & F.col("__u").isNotNull(), F.substring("message_date", 1, 10))}).filter(F.col("__t").isNotNull())
    score = F.when(F.col("__u").isNull(), 0.35).otherwise(_hundredths((F.lit(True), 55), (F.col("__v"), 10), (F.col("__p").isNotNull(), 10)))
    c = F.col
    return schemas.jobs(rows, source=c("source"), source_group=c("source_group"), source_message_id=c("source_message_id"), source_message_url=c("source_message_url"), message_date=c("message_date"), title=c("__t"), posted_on=c("__p"), job_url=c("__u"), raw_text=c("raw_text"), parse_confidence=score)


class ParserRegistry:
    """Parsers of messages by source and group; a group ``*`` is for the source's other groups. Case doesn't count."""

    def __init__(self) -> None:
        self._parsers: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}

    def register(self, source: str, group: str, parser: Callable[[DataFrame], DataFrame]) -> None:
        key = source.strip().casefold(), group.strip().casefold()
        if not all(key):
            raise ValueError("source and group must not be blank")
        if key in self._parsers:
            raise ValueError(f"a parser for {source}/{group} is registered already")
        self._parsers[key] = parser

    def resolve(self, source: str, group: str) -> Callable[[DataFrame], DataFrame]:
        s, g = source.strip().casefold(), group.strip().casefold()
        try:
            return self._parsers.get((s, g)) or self._parsers[s, "*"]
        except KeyError:
            raise LookupError(f"no parser for {source}/{group}") from None

    def parse(self, messages: DataFrame) -> DataFrame:
        """All messages, each by its parser; messages without one are left out."""
        s, g = F.lower(F.trim("source")), F.lower(F.trim("source_group"))
        parts = []
        for (source, group), parser in sorted(self._parsers.items(), key=str):
            own = [k for src, k in self._parsers if src == source and k != "*"]
            mine = (s == source) & (~g.isin(*own) if group == "*" and own else F.lit(True) if group == "*" else g == group)
            parts.append(parser(messages.filter(mine)))
        if not parts:
            raise LookupError("no parser is registered")
        return reduce(DataFrame.unionByName, parts)

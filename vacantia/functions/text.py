"""Text functions: normal forms, URLs, identities, labelled lines, dates, phrases. Columns in, columns out.

Only what Spark has no native form for is an Arrow function: Unicode normal forms and case folding, and HTML entities.
The normal forms differ on purpose, because each feeds other keys; they aren't unified.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAGE_CHARS = 60_000
# Query keys that only track where a visitor came from.
TRACKING_KEYS = ("gh_src", "ref", "referrer", "source", "trackingid", "trk")


@F.pandas_udf(T.StringType())
def nfkc_casefold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if v is None else unicodedata.normalize("NFKC", v).casefold() for v in s], dtype=object)


@F.pandas_udf(T.StringType())
def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if v is None else html.unescape(v) for v in s], dtype=object)


def _normal_form(plain: dict[int, str], gone: str = "", apart: str = ""):
    """A whole normal form in one Arrow pass, so that a text tested for many phrases is normalised once."""
    separators = re.compile(f"[{re.escape(apart)}]+") if apart else None

    @F.pandas_udf(T.StringType())
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for v in s:
                v = unicodedata.normalize("NFKC", v or "").casefold().translate(plain)
                for c in gone:
                    v = v.replace(c, "")
                out.append(" ".join((separators.sub(" ", v) if separators else v).split()))
            yield pd.Series(out, dtype=object)

    return normal


_fingerprint = _normal_form({})
_analysis = _normal_form({0xA0: " ", 0x2013: "-", 0x2014: "-", 0x2019: "'", 0x60: "'"})
_scoring = _normal_form({}, gone="’'`", apart="-_/(),:+&")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def fingerprint_text(text: Column) -> Column:
    """For keys of duplicates: compatibility form, folded case, collapsed; null is empty."""
    return _fingerprint(text)


def analysis_text(text: Column) -> Column:
    """For phrases: as above, with plain dashes and apostrophes; keeps ``+ # . / -``."""
    return _analysis(text)


def scoring_text(text: Column) -> Column:
    """For keywords: apostrophes deleted, separators as spaces."""
    return _scoring(text)


def distinct_neighbours(lines: Column) -> Column:
    """An array without blank elements and without elements equal to the one before them."""
    solid = F.filter(lines, lambda x: F.length(F.trim(x)) > 0)
    return F.transform(F.filter(F.transform(solid, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["i"] == 0) | (s["x"] != F.try_element_at(solid, F.greatest(s["i"], F.lit(1))))), lambda s: s["x"])


def page_text(text: Column) -> Column:
    """A page's text: spaces within lines collapsed, blank and repeated lines dropped, at most 60,000 characters."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u00a0", " "), r"\r\n?", "\n")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.substring(F.array_join(distinct_neighbours(lines), "\n"), 1, MAX_PAGE_CHARS)


def clean_visible_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+$", ""), "[.,;:!?)\\]}\"']+$", "")


def visible_urls(text: Column) -> Column:
    """The URLs written in a text, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(https?://[^\s<>()]+)"), F.lit(1)), clean_visible_url))


URL = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
HOST = r"^(?:\[[0-9a-fA-F:.]+\]|[^:@\[\]\s]+)(?::(?:\d{0,4}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d\d|655[0-2]\d|6553[0-5]))?$"


def normalize_url(url: Column) -> Column:
    """The canonical form of a web address without tracking keys and fragment; empty where it isn't one."""
    clean = clean_visible_url(url)
    part = lambda k: F.regexp_extract(clean, URL, k)
    key = lambda s: F.lower(F.coalesce(F.try_url_decode(F.element_at(F.split(s, "=", 2), 1)), s))
    kept = F.filter(F.split(part(4), "&"), lambda s: (s != "") & ~key(s).startswith("utm_") & ~key(s).isin(*TRACKING_KEYS))
    path = F.when(part(3) == "/", "/").otherwise(F.regexp_replace(part(3), "/+$", ""))
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(clean.rlike(URL) & part(2).rlike(HOST), whole).otherwise("")


def url_host(url: Column) -> Column:
    """Host in lower case without port; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"[\[\]]", "")


def host_within(host: Column, suffixes: list[str]) -> Column:
    """Whether a host is one of the suffixes or below one."""
    out = F.lit(False)
    for s in suffixes:
        out = out | (host == s) | host.endswith("." + s)
    return out


def expected_https_url(url: Column, host: str | Column, prefix: str = "/") -> Column:
    """A URL of exactly this host, by https, without port and user, below a path; else null."""
    ok = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1)) == "https"
    authority = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(ok & (authority == (host.lower() if isinstance(host, str) else F.lower(host))) & path.startswith(prefix), url)


#: Addresses that never are public: local names, and literals of private, loop-back, link-local and reserved ranges.
PRIVATE = r"^(?:localhost|.*\.(?:localhost|local|internal|home\.arpa)|0\..*|10\..*|127\..*|169\.254\..*|172\.(?:1[6-9]|2\d|3[01])\..*|192\.168\..*|192\.0\.[02]\..*|198\.1[89]\..*|198\.51\.100\..*|203\.0\.113\..*|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|(?:22[4-9]|2[3-5]\d)\..*|::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:.*)$"


def is_public_url(url: Column) -> Column:
    """The part of the check for public addresses that needs no name lookup."""
    host = url_host(url)
    return F.coalesce(normalize_url(url) != "", F.lit(False)) & (host != "") & ~host.rlike(PRIVATE)


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def url_identity(url: Column) -> Column:
    """Hash of the canonical URL in lower case; null without one."""
    return F.when(normalize_url(url) != "", sha(F.concat(F.lit("url:"), F.lower(normalize_url(url)))))


def position_fingerprint(title: Column, company: Column, location: Column) -> Column:
    """Hash of title, company and place; null unless all three are there."""
    t, c, p = fingerprint_text(title), fingerprint_text(company), fingerprint_text(location)
    return F.when((t != "") & (c != "") & (p != ""), sha(F.concat(F.lit("position:"), t, F.lit("|"), c, F.lit("|"), p)))


def dedupe_key(url: Column, title: Column, company: Column, location: Column, source: Column, group: Column, message: Column) -> Column:
    """By URL as written, else by text if title, company and place are there, else by the posting's own identity."""
    t, c, p = fingerprint_text(title), fingerprint_text(company), fingerprint_text(location)
    by_text = F.concat(F.lit("text:"), t, F.lit("|"), c, F.lit("|"), p)
    by_source = F.concat(F.lit("source:"), fingerprint_text(source), F.lit("|"), fingerprint_text(group), F.lit("|"), F.lower(F.trim(F.coalesce(message.cast("string"), F.lit("")))))
    return sha(F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), F.lower(F.trim(url)))).when((t != "") & (c != "") & (p != ""), by_text).otherwise(by_source))


def message_fingerprint(group: Column, date: Column, sender: Column, text: Column, occurrence: Column) -> Column:
    """Stable id of a message without id: hash of its group, date, sender, text and number among equal ones."""
    parts = [fingerprint_text(group), F.coalesce(date, F.lit("")), fingerprint_text(sender), fingerprint_text(text), F.concat(F.lit("occurrence:"), occurrence.cast("string"))]
    return F.concat(F.lit("wa_"), sha(F.concat_ws("\n", *parts)))


def split_title_and_company(line: Column) -> tuple[Column, Column]:
    """Title and company around the last `` @ ``; the whole line and null without one."""
    has = line.contains(" @ ")
    title = F.when(has, F.trim(F.regexp_extract(line, r"(?s)^(.*) @ (.*)$", 1))).otherwise(F.trim(line))
    return title, F.when(has, F.nullif(F.trim(F.regexp_extract(line, r"(?s)^(.*) @ (.*)$", 2)), F.lit("")))


def labelled(lines: Column, label: str) -> Column:
    """The value after ``label:`` in the last line that has it."""
    hits = F.filter(lines, lambda x: F.lower(F.trim(x)).startswith(label.lower() + ":"))
    return F.nullif(F.trim(F.substring_index(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), "^[^:]*:", "\u0001"), "\u0001", -1)), F.lit(""))


def posted_date(text: Column) -> Column:
    """A date written ``d-m-Y``, ``d/m/Y`` or ``Y-m-d``; else null."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(t, "d-M-yyyy"), F.try_to_date(t, "d/M/yyyy"), F.try_to_date(t, "yyyy-M-d"))


def date_part(text: Column) -> Column:
    """The date in the first ten characters."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def epoch_millis_date(millis: Column) -> Column:
    return F.expr("date_from_unix_date(0)") + F.floor(millis / 86_400_000).cast("int")


def dates_nearby(a: Column, b: Column, days: int = 21) -> Column:
    """Whether two dates, given as text, are at most so many days apart; false if either can't be read."""
    return F.coalesce(F.abs(F.datediff(date_part(a), date_part(b))) <= days, F.lit(False))


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words at all: a plain search of bytes that spares most texts the expression."""
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def phrase(text: Column, *phrases: str) -> Column:
    """Whether one of the phrases stands in a normalised (so lower-case) text, not inside a word or number."""
    words = tuple(p.casefold() for p in phrases)
    one = "|".join(re.escape(w).replace("\\ ", " ") for w in words)
    words = tuple(w for w in words if not any(v != w and v in w for v in words))
    return _any_in(text, words) & text.rlike(f"(?<![a-z0-9])(?:{one})(?![a-z0-9])")


def keyword(text: Column, *keywords: str) -> Column:
    """As ``phrase``, with the letters of all languages as parts of words."""
    one = "|".join(re.escape(w).replace("\\ ", " ") for w in keywords)
    return _any_in(text, tuple(w for w in keywords if not any(v != w and v in w for v in keywords))) & text.rlike(f"(?U)(?<!\\w)(?:{one})(?!\\w)")


def matching(text: Column, words: list[str], test=phrase) -> Column:
    """The words found in a text, in the order of the list."""
    return F.array_compact(F.array(*[F.when(test(text, w), F.lit(w)) for w in words])) if words else F.array().cast("array<string>")


def alias_groups(text: Column, groups: dict[str, list[str]]) -> Column:
    """The names of the groups of which an alias is found, in the order of the groups."""
    return F.array_compact(F.array(*[F.when(phrase(text, *aliases), F.lit(name)) for name, aliases in groups.items()]))


def keyword_score(text: Column, weights: dict[str, int], cap: int) -> Column:
    """The summed weights of the keywords found, capped."""
    total = F.lit(0)
    for word, weight in weights.items():
        total = total + F.when(keyword(text, word), weight).otherwise(0)
    return F.least(total, F.lit(cap))


def bounded(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: A telephone number: at least eight characters, digits at both ends.
PHONE = r"(?<!\w)\+?\d[\d\s().-]{6,}\d(?!\w)"


def scrub_contacts(text: Column) -> Column:
    """E-mail addresses, URLs, telephone numbers and bullets taken out of a line."""
    plain = F.regexp_replace(text, r"(?i)[\w.+-]+@[\w-]+(?:\.[\w-]+)+", " ")
    plain = F.regexp_replace(plain, r"(?i)https?://\S+", " ")
    plain = F.when(plain.rlike(r"(?i)job\s*id"), plain).otherwise(F.regexp_replace(plain, PHONE, " "))
    return collapse(F.regexp_replace(plain, r"^\s*[•●▪*-]\s+", ""))


def _one_array(text: Column) -> Column:
    """Whether a text is one JSON array and nothing else: readers of JSON ignore what stands after the first value."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    closed = F.length(F.translate(bare, "[", "")) == F.length(F.translate(bare, "]", ""))
    return F.coalesce(bare.rlike(r"(?s)^\s*\[.*\]\s*$") & ~bare.rlike(r"\]\s*\[") & closed, F.lit(False))


def json_objects(text: Column, schema: str) -> Column:
    """A JSON array of objects as structs, elements that aren't objects left out; anything else is an empty array."""
    return F.coalesce(F.when(_one_array(text), F.filter(F.from_json(text, f"array<struct<{schema}>>"), lambda x: x.isNotNull())), F.array().cast(f"array<struct<{schema}>>"))


def greatest_fit(found: Column, fits: dict[str, float]) -> Column:
    """The best fit of the signals found; null if none has a fit."""
    table = F.create_map(*[F.lit(x) for kv in fits.items() for x in kv])
    return F.array_max(F.transform(F.filter(found, lambda s: F.array_contains(F.map_keys(table), s)), lambda s: F.element_at(table, s)))


def missing_keys(keys: Column, required: list[str]) -> Column:
    """The required keys that an array lacks."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))


def json_strings(text: Column) -> Column:
    """A JSON array as an array of texts; anything else, text after the array too, is an empty array."""
    return F.coalesce(F.when(_one_array(text), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def experience_text(low: Column, high: Column) -> Column:
    """``n+ years``, ``n years`` or ``a-b years``."""
    return F.when(low.isNull(), "not specified").when(high.isNull(), F.concat(low.cast("string"), F.lit("+ years"))).when(low == high, F.concat(low.cast("string"), F.lit(" years"))).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" years")))

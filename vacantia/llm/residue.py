"""Template residue and error-page text, by containment of labelled exemplars.

Exemplars are passages labelled ``residue`` (placeholders, error messages, script notices), ``filler`` (the usual filler
text) or ``real`` (genuine sentences about such things). An inverted index leads from a token to the exemplars that hold
it. Each page is read in passage windows: its title, the parts of the title, its lines and pairs of neighbouring lines.
Tokens are weighted by inverse document frequency, counted over the windows of all pages for the tokens of the exemplars.
A window is residue if what it shares with a residue exemplar covers most of the exemplar and of the window, or if most of
it is contained in a filler exemplar, and no ``real`` exemplar covers more of it. Placeholders of any notation are one
token, and so is one word over and over; an exemplar of a placeholder alone matches it in every sentence.

Only the counts of the exemplars' own tokens go to the driver and to the workers; a list of exemplars with over
``MAX_TOKENS`` tokens raises.

Defined results: pages whose texts are both null, empty or blank are kept; very long pages are read whole; repeated
rows give the same verdict; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.tables import spread

MAX_TOKENS = 5000
SLOT, SAME = "slotslot", "samesame"
WINDOWS = "\u0000"
#: Notations of placeholders that a template engine or an editor should have filled in.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{0,60}\}|#\{[^{}\n]{0,60}\}|\{%[^%\n]{0,60}%\}|<%[^%\n]{0,60}%>|%%[\w.]{1,60}%%|@@[\w.]{1,60}@@|\*\|[^|\n]{1,60}\|\*|__[A-Z][A-Z0-9_]*?__|\[\[[^\[\]\n]{1,60}\]\]|<<[^<>\n]{1,60}>>|%[A-Z][A-Z0-9_]{2,40}%|%\(\w+\)s"
    r"|[\[<][^\[\]<>\n]{0,40}\b(?:tbc|tbd|to be (?:confirmed|defined|announced))\b[^\[\]<>\n]{0,40}[\]>]"
    r"|[\[<](?:insert|enter|add|your|fill in|company name|job title|name|title|company|location|role|date|salary|department|team|placeholder|tbd|xxx)\b[^\[\]<>\n]{0,50}[\]>]|\{(?:[a-z]+[A-Z_][A-Za-z_]*|[A-Z][A-Z_]{2,40}|[a-z]+(?:_[a-z]+)+|name|title|company|location|role|team|salary|date)\}",
    re.I,
)

# The labelled exemplars.
RESIDUE = """
slotslot
samesame
%s %s %s
[object Object]
undefined
null
NaN
xxx xxx xxx
#REF!
Text coming soon.
test test test test
blah blah blah
asdf asdf asdf asdf
qwerty qwerty qwerty qwerty
TODO: copy the responsibilities from the last posting.
lorem ipsum dolor sit amet
Body text body text body text.
Heading 1
Bullet one
Bullet two
Bullet three
Sample text goes here.
Text goes here
Job description to be added.
Description to be added
Enter a short description of the role.
Description placeholder - replace before publishing.
This is placeholder text.
Page title goes here
Untitled document
Untitled slotslot
Untitled page
New page
Test page
TODO: write description
404
404 - Page not found
404 Not Found
Page not found
The page you are looking for could not be found.
The page you requested does not exist. It may have moved.
It may have moved.
This page does not exist
Error 404
Fehler 404
Seite nicht gefunden. Die gesuchte Stelle existiert nicht (Fehler 404).
Page introuvable. Cette offre n'existe plus (erreur 404).
Página no encontrada. La oferta no existe (error 404).
403 Forbidden
429
429 Too Many Requests
Too many requests from your network. Slow down and retry later.
The page you asked for could not be found on example.
500 Internal Server Error
Internal server error. Our team has been told. Please try again in a few minutes.
Server error
Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
Service temporarily unavailable. Please try again later.
Oops
Oops! Something went wrong while loading this vacancy. Error code 0
Something went wrong
An unexpected error occurred
Fatal error: uncaught exception in /app/views/job.tpl on line 0
Stack trace: #0 render() #1 main()
Access denied
You do not have permission to view this page.
Log in
Your session has expired. Log in again to see this vacancy.
Please log in to continue
Maintenance
is down for maintenance. We will be back at 0:00.
The site is under maintenance
Security check
Please confirm that you are not a robot. Solve the puzzle to go on.
Just one second...
One moment please
Checking your browser before opening the site. This takes a few seconds.
JavaScript is disabled in your browser. Enable it and reload.
Please enable JavaScript to view this page
This careers portal requires JavaScript.
You need to turn on JavaScript to use this application.
does not work without JavaScript enabled.
Please activate scripts to continue. Loading...
If nothing happens, allow scripts for this page.
Your browser is not supported. Scripts must be allowed for jobs example.
Loading…
Bitte aktivieren Sie JavaScript, um die Stelle zu sehen.
Veuillez activer JavaScript pour voir cette offre.
Active JavaScript para ver esta oferta.
"""
REAL = """
You know how slotslot substitution works in shell scripts.
You write templates with slotslot bindings in Vue and keep them tidy.
You keep null and undefined values out of our TypeScript code.
You replace lorem ipsum texts in our design system with real copy.
You will lower the rate of 404 and 502 answers of our public site.
The stack trace viewer and the access denied page belong to your team.
The maintenance window is on Sunday, and you plan it.
Knowledge of JavaScript is required for this role.
Our error pages were written by the design team, and you will maintain them.
Experience with test automation: test, test and test again is our motto.
JavaScript Developer, Error Pages
Test Engineer (Template Systems)
"""
# The words of the usual filler text, as one passage.
FILLER = ("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vel massa porta rutrum pretium turpis felis tempus nec libero",)
TOKEN = re.compile(r"%s|\[object|[^\W_]+", re.I)


#: Every placeholder has one of these characters.
MARKS = re.compile(r"[{<%@_\[]|\*\|")
CODES = {"403", "404", "429", "500", "502", "503", "504"}
#: A word so often in a row, and nothing else, is one word over and over.
OVER = 4


def tokens(text: str) -> list[str]:
    """Tokens of a passage: placeholders are one token, numbers other than status codes are one, and so is a passage of
    one word over and over."""
    plain = PLACEHOLDER.sub(f" {SLOT} ", text) if MARKS.search(text) else text
    out = [w if not w.isdigit() or w in CODES else "0" for w in TOKEN.findall(plain.casefold())]
    if len(out) >= OVER and out[0] != "0" and out.count(out[0]) == len(out):
        return [SAME]
    return out


def _passages(text: str | tuple[str, ...], label: str) -> list[tuple[frozenset[str], str]]:
    return [(frozenset(tokens(e)), label) for e in (text.strip().split("\n") if isinstance(text, str) else text)]


EXEMPLARS = _passages(RESIDUE, "residue") + _passages(REAL, "real") + _passages(FILLER, "filler")
VOCABULARY = sorted(set().union(*(e for e, _ in EXEMPLARS)))
INDEX: dict[str, list[int]] = {}
for _k, (_e, _) in enumerate(EXEMPLARS):
    for _t in _e:
        INDEX.setdefault(_t, []).append(_k)


def window_counts(titles: Iterable[str | None], texts: Iterable[str | None]) -> Counter:
    """In how many windows each token of the exemplars stands, and under ``WINDOWS`` how many there are."""
    lines: Counter = Counter()
    for part in (titles, texts):
        for text in part:
            if isinstance(text, str):
                lines.update(x for line in text.split("\n") if (x := line.strip()))
    count, vocabulary = Counter({WINDOWS: sum(lines.values())}), frozenset(VOCABULARY)
    for line, n in lines.items():
        for t in vocabulary.intersection(tokens(line)):
            count[t] += n
    return count


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        count = window_counts(rows["page_title"], rows["description_text"])
        yield pd.DataFrame({"t": list(count), "n": list(count.values())})


def weights(count: dict[str, int]) -> tuple[dict[str, float], float]:
    """The weight of each token of the exemplars and that of a token unknown to them."""
    if len(VOCABULARY) > MAX_TOKENS:
        raise ValueError(f"the exemplars have over {MAX_TOKENS} tokens")
    total = count.get(WINDOWS, 0)
    return {t: math.log((total + 1) / (count.get(t, 0) + 1)) + 1 for t in VOCABULARY}, math.log(total + 1) / 2 + 1


def idf_table(details: DataFrame) -> tuple[dict[str, float], float]:
    """The weights, from the windows of all pages; the counts are those of the exemplars' tokens and no others."""
    rows = spread(details.select("job_id", "page_title", "description_text"), "job_id").select("page_title", "description_text")
    counted = rows.mapInPandas(_counted, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    return weights({r.t: r.n for r in counted.collect()})


#: Verdicts remembered in a worker process; only saves time.
KEEP_WINDOWS = 200_000


class Judge:
    """Judges the windows of pages."""

    def __init__(self, idf: dict[str, float], other: float, contain: float = 0.75, cover: float = 0.55, filler: float = 0.7) -> None:
        self.idf, self.other, self.contain, self.cover, self.filler = idf, other, contain, cover, filler
        self.mass = [sum(idf[t] for t in e) for e, _ in EXEMPLARS]
        self.known: dict[str, tuple[bool, bool]] = {}

    def window(self, text: str) -> tuple[bool, bool]:
        """Whether a window is residue, and whether it may be so together with its neighbour."""
        hit = self.known.get(text)
        if hit is None:
            if len(self.known) > KEEP_WINDOWS:
                self.known.clear()
            row = tokens(text)
            words = set(row)
            # Only the tokens that exemplars hold can cover a window: without most of it no exemplar can.
            held = sum(self.idf[w] for w in words if w in self.idf)
            mass = held + self.other * sum(w not in self.idf for w in words)
            near = bool(row) and (SLOT in words or held >= self.cover * mass)
            is_residue, genuine = self._matches(row, words, mass) if near else (False, False)
            hit = self.known[text] = is_residue, near and not genuine
        return hit

    def _matches(self, row: list[str], words: set[str], mass: float) -> tuple[bool, bool]:
        """Whether a window is residue, and whether it is a genuine sentence about such things."""
        shared: dict[int, float] = {}
        for t in words:
            for k in INDEX.get(t, ()):
                shared[k] = shared.get(k, 0.0) + self.idf[t]
        real = max((s / mass for k, s in shared.items() if EXEMPLARS[k][1] == "real" and s >= 0.5 * self.mass[k]), default=0.0)
        if real >= 0.7:
            return False, True
        for k, s in shared.items():
            words_of, label = EXEMPLARS[k]
            if label == "filler" and len(row) >= OVER and s >= self.filler * mass:
                return True, False
            if label == "residue" and s >= self.contain * self.mass[k]:
                if len(words_of) == 1 and SLOT in words_of or s >= self.cover * mass and s / mass > real:
                    return True, False
        return False, False

    def page(self, title: str | None, text: str | None) -> bool:
        if title and any(self.window(p)[0] for p in [title, *re.split(r" [|·-] ", title)] if p.strip()):
            return True
        before = None
        for line in text.split("\n") if text else ():
            line = line.strip()
            if not line:
                continue
            is_residue, near = self.window(line)
            if is_residue or near and before is not None and self.window(f"{before} {line}")[0]:
                return True
            before = line if near else None
        return False


def marker(details: DataFrame, judge: Judge | None = None):
    """A column function over title and text: whether a page is residue; weights are counted over all of ``details``."""
    judge = judge or Judge(*idf_table(details))

    @F.pandas_udf(T.BooleanType())
    def residue(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for titles, texts in batches:
            yield pd.Series([judge.page(t if isinstance(t, str) else None, d if isinstance(d, str) else None) for t, d in zip(titles, texts)], dtype=bool)

    return residue.asNondeterministic()  # so that it isn't evaluated before small inputs are spread


def found(details: DataFrame) -> DataFrame:
    """p5_found: distinct pages with residue, filler, an error message or a script notice."""
    rows = spread(details.select("job_id", "page_title", "description_text").filter("page_title is not null or description_text is not null"), "job_id")
    return rows.filter(marker(details)("page_title", "description_text")).select("job_id").distinct()

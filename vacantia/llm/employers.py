"""Variant spellings of employers, linked by canonical rewritings.

Each distinct name is parsed once: marks, case, punctuation, legal forms and hiring remarks go, short and mistyped trade
words become the whole word, run-together names are cut at their trade words, and the other words are put in order. That
gives the key of the name. Every key then writes itself as *forms*:

- as it stands with one letter left out of a word (two keys with a common form differ by one typing error),
- with the nickname of a word (its last syllable left out), with a word as initial, as one word, as acronym with one
  word, as acronym alone, and as one word alone.

Forms are exploded and joined by equality. A form is worth the more the rarer it is: the number of keys that write it
decides which of several rewritings links a key, and one that several employers share (a bare invented word, an acronym)
links nothing. Each key so gets at most one parent, never pairs; typing errors are followed to their end, then
shortenings in two kinds, each followed twice, to the root, whose name stands for the employer.

Defined results: null, blank and useless names ("n/a", "confidential") belong to no employer; names that differ only in
case or spaces are different spellings of one; names of any length are rewritten, and forms over ``LONG`` characters stand as digests; repeated rows
count as weight; ties go to the smaller key; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.tables import cut_lineage, numbered

# Legal forms, words of trades, their usual short forms, and remarks that aren't part of a name.
LEGAL = {"ltd", "limited", "llc", "llp", "inc", "incorporated", "gmbh", "sa", "bv", "nv", "ag", "kg", "plc", "corp", "corporation", "co", "company", "pty", "pte", "pvt", "oy", "ab", "as", "srl", "spa", "sarl", "sas", "ug", "se", "lp"}
TRADES = ("analytics", "consulting", "education", "energy", "group", "holdings", "industries", "insurance", "international", "laboratories", "logistics", "manufacturing", "media", "medical", "networks", "partners", "payments", "robotics", "security", "services", "software", "solutions", "systems", "technologies", "ventures")
SHORT = {"grp": "group", "hldgs": "holdings", "intl": "international", "labs": "laboratories", "mfg": "manufacturing", "mnfg": "manufacturing", "edu": "education", "pmts": "payments", "svcs": "services", "svc": "services", "solns": "solutions", "sols": "solutions", "tech": "technologies", "techs": "technologies", "sys": "systems", "sw": "software", "medcl": "medical", "ins": "insurance", "ind": "industries", "inds": "industries", "nets": "networks", "sec": "security", "log": "logistics"}
USELESS = {"", "n a", "na", "none", "null", "nil", "unknown", "confidential", "private", "company", "a company", "employer", "undisclosed", "tbd", "tba", "various", "self employed", "freelance", "a growing company", "growing company", "our client", "client", "stealth", "stealth startup", "startup", "a startup", "not specified", "see ad", "test", "x", "xx", "xxx", "hidden", "anonymous", "company name", "name withheld", "leading company", "a leading company", "hiring company", "recruiter", "agency", "hr", "hiring"}
JOINERS = {"the", "and", "a", "und", "et", "y"}
REMARKS = re.compile(r"\[[^\]]*\]|\((?:hq|hiring|careers?|ltd\.?|inc\.?|llc|gmbh|group hq|we.?re hiring)\)|\br\s*&\s*d(?:\s+cent(?:er|re))?|/?\s*talent\s+team|\b(?:careers?|jobs|hiring|recruiting|recruitment|talent acquisition|hr)\b", re.I)
WITH_ACRONYM = re.compile(r"^\s*([A-Za-z]{2,7})[\s_-]*\(\s*([^()]+?)\s*\)\s*$")
ALONE = re.compile(r"^[A-Z]{2,6}$")
VOWELS = set("aeiou")

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("typing", T.ArrayType(T.StringType())), T.StructField("offers", T.ArrayType(T.StringType())), T.StructField("asks", T.ArrayType(T.StringType()))])


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """At most one typing error apart, swapped neighbours counting as one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _within(word: str, whole: str) -> bool:
    rest = iter(whole)
    return all(c in rest for c in word)


def trade(word: str, dotted: bool) -> str | None:
    """The trade word that a word is, abbreviates or misspells."""
    if word in TRADES:
        return word
    if word in SHORT:
        return SHORT[word]
    if dotted and len(word) >= 2:
        fits = [t for t in TRADES if t.startswith(word)]
        if len(fits) == 1 or fits and len(word) >= 4:
            return min(fits, key=len)
    if len(word) >= 3:
        # Letters left out: the trade word of which the most is left, at least half (less if only consonants are left).
        least = 0.4 if not VOWELS & set(word[1:]) else 0.5 if len(word) >= 4 else 1
        fits = [(len(word) / len(t), t) for t in TRADES if t[0] == word[0] and len(word) >= least * len(t) and _within(word, t)]
        if fits:
            return max(fits)[1]
    if len(word) >= 5:
        fits = [t for t in TRADES if near(word, t)]
        if len(fits) == 1:
            return fits[0]
    return None


def parse(name: str) -> dict | None:
    """The words of a name by role, or None where it names nobody."""
    plain = re.sub(r"['’`]", "", fold(name))
    whole = re.sub(r"[^\w]+|_+", " ", plain.casefold()).strip()
    if whole in USELESS or not re.search(r"[^\W\d_]", whole):
        return None
    acronym = ""
    if (m := WITH_ACRONYM.match(plain)) and m[2].casefold().strip(". ") not in LEGAL and not REMARKS.search(f"({m[2]})"):
        acronym, plain = m[1].casefold(), m[2]
    text = re.sub(r"\b([A-Za-z])\.([A-Za-z])\.", r"\1\2", REMARKS.sub(" ", plain))
    words = re.findall(r"([^\W_]+)(\.?)", re.sub(r"[&+]", " and ", text))
    solid = [w for w in words if w[0].casefold() not in LEGAL]
    if len(solid) == 1 and re.search(r"[a-z][A-Z]", solid[0][0]):
        cut = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", solid[0][0]).split()
        cut = [c[:-3] if c.endswith("and") and len(c) > 7 and k + 1 < len(cut) else c for k, c in enumerate(cut)]
        solid = [(c, "") for c in cut[:-1]] + [(cut[-1], solid[0][1])]
    rest, order, trades = [], [], []
    alone = len(solid) == 1 and bool(ALONE.match(solid[0][0])) and len(solid[0][0]) <= 6 and not acronym and solid[0][0].casefold() not in SHORT
    for word, dot in solid:
        w = word.casefold()
        if w in JOINERS and not (word == "A" and len(solid) > 2 and not plain.isupper()):  # a capital A is an initial
            if w == "the":
                order.append(w)
            continue
        if w in LEGAL:
            continue
        t = None if alone else trade(w, bool(dot))
        if t is None and len(solid) <= 2 and len(w) > 9:  # written as one word
            w, found = _cut(w, bool(dot))
            trades += found
            if w.startswith("the") and len(w) > 8 and found:
                w = w[3:]
        if t:
            trades.append(t)
            order.append(t)
        else:
            rest.append(w)
            order.append(w)
    if not rest and not trades:
        return None
    return {"rest": rest, "order": order, "trades": sorted(set(trades)), "acronym": acronym, "alone": alone}


def _cut(word: str, dotted: bool) -> tuple[str, list[str]]:
    """A word without the trade words at its end, and these."""
    found: list[str] = []
    while True:
        end = next((t for t in sorted(TRADES, key=len, reverse=True) if word.endswith(t) and len(word) - len(t) >= 4), None)
        if end:
            found.append(end)
            word = word[: -len(end)]
            continue
        if dotted and not found:
            hit = next(((word[:-k], t) for k in range(9, 2, -1) for t in TRADES if len(word) - k >= 5 and t.startswith(word[-k:])), None)
            if hit:
                return hit[0], [hit[1]]
        return word, found


LONG = 200


def _brief(form: str) -> str:
    """A form, or its kind and digest where it is long: a name has as many forms as letters, and forms are only compared."""
    return form if len(form) <= LONG else form[0] + hashlib.sha256(form.encode("utf-8", "surrogatepass")).hexdigest()


def _left_out(word: str) -> list[str]:
    """A word alone, and with one letter left out."""
    return [_brief(f"C{word}"), _brief(f"E{word}")] + ([_brief(f"E{word[:i]}{word[i + 1 :]}") for i in range(len(word))] if len(word) >= 6 else [])


def _initial(letter: str, others: list[str], tail: str) -> list[str]:
    """An initial with the one other word, one letter of it left out."""
    if len(others) != 1 or len(others[0]) < 6:
        return []
    w = others[0]
    return [_brief(f"G{letter}|{w}{tail}")] + [_brief(f"G{letter}|{w[:i]}{w[i + 1 :]}{tail}") for i in range(len(w))]


def forms(p: dict) -> tuple[str, list[str], list[str], list[str]]:
    """Key, forms with a letter left out, forms by which shorter names may find this one, forms by which it finds longer ones."""
    rest, tail = sorted(set(p["rest"])), "#" + "+".join(p["trades"])
    key = ("@" + p["acronym"] if p["acronym"] else "!" if p["alone"] else "") + "|".join(rest) + tail
    if p["acronym"] or p["alone"]:
        if p["alone"]:
            return key, [], [], [f"B{rest[0]}"]
        return key, [], [], [_brief(f"A{p['acronym']}|{c}") for c in rest] + [f for c in rest for f in _left_out(c)]
    typing, offers, asks = set(), set(), set()
    for k, w in enumerate(rest):
        others = "|".join(rest[:k] + rest[k + 1 :]) + tail
        typing.add(_brief(f"D{w}|{others}"))
        if len(w) >= 5:
            typing |= {_brief(f"D{w[:i]}{w[i + 1 :]}|{others}") for i in range(len(w))}
        if len(w) == 1:
            asks |= {_brief(f"M{w}|{others}"), *_initial(w, rest[:k] + rest[k + 1 :], tail)}
        if len(w) >= 4:
            asks.add(_brief(f"N{w}|{others}"))
        if len(w) >= 7:
            offers |= {_brief(f"N{w[:-n]}|{others}") for n in (3, 4) if len(w) - n >= 4}
        if len(rest) > 1 and len(w) > 1:
            offers |= {_brief(f"M{w[0]}|{others}"), *_initial(w[0], rest[:k] + rest[k + 1 :], tail)}
    full = (bool(p["trades"]) or len(rest) > 1) and all(len(w) > 1 for w in rest)
    if full:
        initials = "".join(w[0] for w in p["order"])
        for w in rest:
            if len(w) >= 5:
                offers |= {_brief(f"A{initials}|{w}"), *_left_out(w)}
        offers.add(_brief(f"B{initials}"))
        if len(p["rest"]) == 2:
            one, two = p["rest"]
            offers |= {_brief(f"J{a}{j}{b}{tail}") for a, b in ((one, two), (two, one)) for j in ("", "and")}
    if len(rest) == 1:
        asks.add(_brief(f"J{rest[0]}{tail}"))
        if not p["trades"]:
            asks |= set(_left_out(rest[0]))
    return key, sorted(typing), sorted(offers), sorted(asks)


@F.pandas_udf(SCHEMA)
def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The key and the forms of each name; nulls where it names nobody."""
    for s in batches:
        rows = [forms(p) if name is not None and (p := parse(name)) else (None, None, None, None) for name in s]
        yield pd.DataFrame(rows, columns=["key", "typing", "offers", "asks"])


#: Which kinds of form win, and whether the form may be shared by several keys.
RANK = {"N": 0, "M": 1, "J": 2, "G": 3, "A": 4, "C": 5, "E": 6, "B": 7}
#: Bits of a base's number and of the count of bases that share a form, in the choice of the best form.
BASE_BITS, SHARED_BITS = 40, 20


def employers(names: DataFrame) -> DataFrame:
    """(name, employer) for a frame with one column ``name``; ``employer`` is the root key.

    Keys are numbered by weight, of equal ones the smaller key last, so that the heaviest of several is the largest number
    and all choices are maxima or minima of whole numbers, taken before the shuffle."""
    seen = names.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
    # Cut twice: a filter on the key would be pushed below the count and parse every row, not every name.
    known = cut_lineage(cut_lineage(seen).select("name", "n", parsed("name").alias("p")).select("name", "n", "p.*").filter(F.col("key").isNotNull()))
    keys = known.groupBy("key").agg(F.sum("n").alias("weight"), F.first("typing").alias("typing"))
    keys = cut_lineage(numbered(keys, F.col("weight").asc(), F.col("key").desc(), out="id"))
    # The order of words and so the acronym may differ between names of one key: all their forms count.
    held = cut_lineage(known.drop("typing", "n").join(keys.select("key", "id"), "key"))
    forms_of = lambda c: held.select("id", F.explode(c).alias("form")).distinct()
    offers, asks = cut_lineage(forms_of("offers")), cut_lineage(forms_of("asks"))

    # Typing errors: the heaviest key of each form is a parent of the others.
    typing = keys.select("id", "key", F.explode("typing").alias("form"))
    heaviest = typing.groupBy("form").agg(F.max("id").alias("parent"))
    pairs = typing.join(heaviest, "form").filter("parent <> id").select("id", "key", "parent").distinct()
    right = pairs.join(keys.select(F.col("id").alias("parent"), F.col("key").alias("parent_key")), "parent").filter(F.levenshtein("key", "parent_key") <= 2)
    right = cut_lineage(right.groupBy("id").agg(F.max("parent").alias("parent")))
    # Corrections are followed to their end: parents are heavier than their keys, so a chain never turns back.
    step = keys.select("id", "weight").join(right, "id", "left").select("id", "weight", F.coalesce("parent", "id").alias("base"))
    while True:
        further = step.join(right.select(F.col("id").alias("base"), "parent"), "base", "left").select("id", "weight", F.coalesce("parent", "base").alias("base"), F.col("parent").isNotNull().alias("moved"))
        step = cut_lineage(further)
        if step.filter("moved").isEmpty():
            break
    step = step.drop("moved")

    # Shortenings that keep most of a name, then those that keep one word or none: by the rarest form.
    step = _shortened(step, offers, asks, "NMJG")
    step = _shortened(step, offers, asks, "ACEB")
    roots = step.join(keys.select(F.col("id").alias("base"), F.col("key").alias("employer")), "base")
    return held.select("name", "id").join(roots.select("id", "employer"), "id").select("name", "employer")


def _shortened(step: DataFrame, offers: DataFrame, asks: DataFrame, kinds: str) -> DataFrame:
    """``step`` (id, weight, base) with each base replaced by the longer one that its forms of these kinds find."""
    kind = F.substring("form", 1, 1)
    bases = numbered(step.groupBy("base").agg(F.sum("weight").alias("weight")), F.col("weight").asc(), F.col("base").asc(), out="rank").select("base", "rank")
    step = cut_lineage(step.join(bases, "base"))
    near = step.select("id", "rank")
    offered = offers.filter(kind.isin(*kinds)).join(near, "id").select("form", "rank").distinct()
    rare = offered.groupBy("form").agg(F.count("*").alias("shared"), F.max("rank").alias("top"))
    asked = asks.filter(kind.isin(*kinds)).join(near, "id").select("form", F.col("rank").alias("asker")).distinct()
    order = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), kind).cast("bigint")
    hits = asked.join(rare, "form").filter((F.col("top") != F.col("asker")) & ((F.col("shared") == 1) | (kind == "N")))
    # The kind, then the rarest form, then the heaviest base, in one whole number.
    most_bases, most_shared = F.lit(2**BASE_BITS - 1), F.lit(2**SHARED_BITS - 1)
    best = F.shiftleft(order, BASE_BITS + SHARED_BITS) + F.shiftleft(F.least("shared", most_shared).cast("bigint"), BASE_BITS) + (most_bases - F.col("top"))
    longer = cut_lineage(hits.groupBy("asker").agg(F.min(best).alias("best")).select("asker", (most_bases - F.col("best").bitwiseAND(most_bases)).alias("longer")))
    up = longer.select(F.col("asker").alias("longer"), F.col("longer").alias("longest"))
    moved = cut_lineage(longer.join(up, "longer", "left").select("asker", F.coalesce("longest", "longer").alias("to")))
    target = moved.join(bases.withColumnRenamed("rank", "to"), "to").select(F.col("asker").alias("rank"), F.col("base").alias("new"))
    return cut_lineage(step.join(target, "rank", "left").select("id", "weight", F.coalesce("new", "base").alias("base")))


def names_of(jobs: DataFrame, normalized: DataFrame) -> DataFrame:
    return jobs.select(F.col("company").alias("name")).unionAll(normalized.select(F.col("company").alias("name")))


def found(jobs: DataFrame, normalized: DataFrame) -> DataFrame:
    """p1_found: every pair of different spellings of one employer, as TESTDATA.md asks for."""
    linked = employers(names_of(jobs, normalized))
    a, b = linked.select(F.col("name").alias("name_a"), "employer"), linked.select(F.col("name").alias("name_b"), "employer")
    return a.join(b, "employer").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")

"""Freely typed places to entries of a reference list.

Every entry is written into a trie along all its paths: label, aliases, parts in reverse order, without spaces, with
the usual short forms of its parts, and the fixed phrases of remote work. A typed value is cut into candidate phrases
(whole value, parts between commas, slashes, dashes and brackets, each also without postcode and words such as
"region" or "near"), and each candidate is run through the trie as a Levenshtein automaton: one row of the edit matrix
for each node, swapped neighbours counting as one edit, and branches left as soon as no cell is within the distance.
The distance depends on the length of the candidate (``allowed``). All entries within it come back; the nearest wins,
then one whose country is named in the value, then the smallest id.

Defined results: null and blank values give null; a value that means no entry gives 0 ("Client site", a town that isn't
in the list even if its country is, names of several entries that tie between countries resolve to the smallest id);
long values are read whole; an empty list gives 0; repeated rows stay repeated; other columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.tables import cut_lineage, lookup

#: Short forms of parts of place names.
SHORT = {"saint": ("st", "ste", "snt"), "port": ("pt", "prt"), "mount": ("mt", "mnt", "mtn"), "upper": ("upr", "uppr", "up"), "lower": ("lwr", "lr", "low"), "harbor": ("hbr", "harbour", "hrb", "hb")}
#: What people write for work without a place.
REMOTE = ("remote", "100 remote", "fully remote", "anywhere", "anywhere remote", "work from home", "working from home", "wfh", "home office", "homeoffice", "telework", "teleworking", "work remotely", "remotely", "remote work", "remote working", "full remote", "remote only", "remote first", "from home", "home based", "telecommute", "telecommuting", "remoto", "distributed")
#: Words around a place that don't name it.
AROUND = re.compile(r"\b(?:greater|area|region|metro|metropolitan|and surroundings?|surroundings|surrounding area|city of|city|town|nationwide|countrywide|hybrid|on site|onsite|office|offices|in office|\d+ days? office|near|close to|around|outskirts of|all of|all over|anywhere in|everywhere in|throughout|across|based in|in|at|the|whole of|entire|north district|south district|east district|west district|central district|district|downtown|centre|center|county|province|state|country)\b")
POSTCODE = re.compile(r"\b\d{3,6}\b")
MAX_ENTRIES = 200_000
#: Characters of all paths of the list; some 14 bytes each are held by every worker process.
MAX_PATH_CHARACTERS = 16_000_000
#: Phrases remembered in a worker process; only saves time.
KEEP_PHRASES = 200_000


def fold(text: str) -> str:
    """Lower case without marks and punctuation; spaces collapsed."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return re.sub(r"[^\w]+|_+", " ", text).strip()


def without_around(text: str) -> str:
    """A folded phrase without postcode and words that stand around a place."""
    return " ".join(AROUND.sub(" ", POSTCODE.sub(" ", text)).split())


def allowed(length: int) -> int:
    """Edits a candidate of this many characters may have."""
    return 0 if length < 4 else 1 if length < 16 else 2


class Trie:
    """Paths to entries, searched with a Levenshtein automaton. Nodes lie in three arrays in order of their depth, so that
    the children of a node are neighbours: some 14 bytes a node instead of a table each."""

    def __init__(self, pairs: Iterable[tuple[str, int]] = ()) -> None:
        self.pairs: list[tuple[str, int]] | None = list(pairs)

    def add(self, path: str, entry: int) -> None:
        self.pairs.append((path, entry))

    def _freeze(self) -> None:
        """Lays the nodes out; from here on the trie only answers."""
        every, self.pairs = sorted(set(self.pairs)), None
        if (size := sum(len(p) for p, _ in every)) > MAX_PATH_CHARACTERS:
            raise ValueError(f"the paths of the reference list have {size} characters, over {MAX_PATH_CHARACTERS}")
        self.start, letters, self.entries = array("i"), [""], {}
        level, depth, made = [(0, len(every))], 0, 1
        while level:
            below = []
            for low, high in level:
                self.start.append(made)
                ends = low
                while ends < high and len(every[ends][0]) == depth:
                    ends += 1
                if ends > low:
                    self.entries[len(self.start) - 1] = tuple(e for _, e in every[low:ends])
                at = ends
                while at < high:
                    c, to = every[at][0][depth], at
                    while to < high and every[to][0][depth] == c:
                        to += 1
                    letters.append(c)
                    below.append((at, to))
                    made += 1
                    at = to
            level, depth = below, depth + 1
        self.start.append(made)
        self.letter = "\0" + "".join(letters[1:])

    def search(self, word: str, most: int) -> list[tuple[int, int]]:
        """(distance, entry) of all entries with a path within ``most`` edits of ``word``, each at its least distance."""
        if self.pairs is not None:
            self._freeze()
        best: dict[int, int] = {}
        start, letter, entries = self.start, self.letter, self.entries
        n, far = len(word), most + 1

        def finish(node: int, at: int) -> None:
            """The entries below a node whose rest is exactly the word's from ``at``: no edit is left."""
            for c in word[at:]:
                node = letter.find(c, start[node], start[node + 1])
                if node < 0:
                    return
            for e in entries.get(node, ()):
                best[e] = min(best.get(e, far), most)

        # A state is a node, its depth, the character that led to it and the last two rows, each only of the cells within
        # ``most`` of the diagonal: row[j] is the distance of the path to the first depth - most + j characters.
        width = 2 * most + 1
        first = [max(0, j - most) if j >= most else far for j in range(width)]
        stack = [(0, 0, "", None, first)]
        while stack:
            node, depth, last, before, row = stack.pop()
            low = min(row)
            if low >= most:  # all edits are used up but for a swap that the next character may complete
                for j in range(width):
                    if row[j] == most and 0 <= depth - most + j <= n:
                        finish(node, depth - most + j)
                    k = depth + 1 - most + j
                    if before and before[j] == most - 1 and 1 < k <= n and word[k - 1] == last:
                        child = letter.find(word[k - 2], start[node], start[node + 1])
                        if child >= 0:
                            finish(child, k)
                continue
            if node in entries:
                j = n - depth + most
                if 0 <= j < width and row[j] <= most:
                    for e in entries[node]:
                        best[e] = min(best.get(e, far), row[j])
            for child in range(start[node], start[node + 1]):
                c = letter[child]
                new, k = [far] * width, depth + 1 - most
                for j in range(width):
                    if 0 <= k <= n:
                        cost = row[j + 1] + 1 if j + 1 < width else far  # the path has one character more
                        if k:
                            if (x := row[j] + (word[k - 1] != c)) < cost:
                                cost = x
                            if j and (x := new[j - 1] + 1) < cost:
                                cost = x
                            if before and k > 1 and word[k - 1] == last and word[k - 2] == c and (x := before[j] + 1) < cost:
                                cost = x
                        new[j] = cost
                    k += 1
                stack.append((child, depth + 1, c, row, new))
        return sorted((d, e) for e, d in best.items())


def paths(label: str, aliases: list[str]) -> set[str]:
    """Every way to write an entry that isn't a typing error."""
    out = set()
    for name in [label, *(aliases or [])]:
        words = fold(name).split()
        forms = {tuple(words)}
        for i, w in enumerate(words):
            forms |= {(*f[:i], s, *f[i + 1 :]) for f in set(forms) for s in SHORT.get(w, ())}
        if len(words) == 2:
            forms |= {(b, a) for a, b in set(forms)}
        out |= {" ".join(f) for f in forms} | {"".join(words)}
    return out


class Gazetteer:
    """The list in searchable form; built on the driver from at most ``MAX_ENTRIES`` entries and sent with the function."""

    def __init__(self, entries: list[tuple]) -> None:
        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"the reference list has over {MAX_ENTRIES} entries")
        self.kind, self.code, self.codes, self.names = {}, {}, {}, {}
        pairs: list[tuple[str, int]] = []
        for entry, label, kind, code, country, aliases in entries:
            self.kind[entry], self.code[entry] = kind, code
            pairs += [(path, entry) for path in paths(label, aliases) | (set(REMOTE) if kind == "remote" else set())]
            if code:
                self.codes[code.casefold()] = code
            if country:
                self.names[fold(country)] = code
        self.trie = Trie(pairs)
        self.trie.search("", 0)  # laid out on the driver, so that workers receive arrays
        self.seen: dict[str, list[tuple[int, int]]] = {}

    def near(self, phrase: str) -> list[tuple[int, int]]:
        if not phrase:
            return []
        found = self.seen.get(phrase)
        if found is None:
            if len(self.seen) > KEEP_PHRASES:
                self.seen.clear()
            hits = self.trie.search(phrase, 0) or self.trie.search(phrase, allowed(len(phrase)))
            found = self.seen[phrase] = [h for h in hits if h[0] == hits[0][0]]
        return found

    def country(self, phrase: str) -> str | None:
        """The country code a phrase names, by code, name or mistyped name."""
        if phrase in self.codes:
            return self.codes[phrase]
        for _, e in self.near(phrase):
            if self.kind[e] == "country":
                return self.code[e]
        return None

    def parts(self, value: str) -> list[tuple[str, str]]:
        """The parts of a value between separators, each as it is and without postcode and words around a place."""
        out = []
        for part in re.split(r"[,/|;()\[\]]|\s[-–—·]\s", value):
            if part.strip():
                text = fold(part)
                out.append((text, without_around(text)))
        return out

    def options(self, value: str, parts: list[tuple[str, str]]) -> list[list[str]]:
        """The candidate phrases of a value; of those in one list the first that is found counts."""
        whole = fold(value)
        # Two parts may be one name in reverse order.
        return [[whole, without_around(whole)]] + [list(p) for p in parts] + [[f"{a[0]} {b[0]}"] for a, b in zip(parts, parts[1:])]

    def within(self, value: str) -> list[tuple[int, int]]:
        """(distance, entry) of every entry within the distance of a candidate phrase, nearest first."""
        best: dict[int, int] = {}
        for phrase in {p for option in self.options(value, self.parts(value)) for p in option if p}:
            for d, e in self.trie.search(phrase, allowed(len(phrase))):
                best[e] = min(d, best.get(e, d))
        return sorted((d, e) for e, d in best.items())

    def resolve(self, value: str) -> int:
        whole = fold(value)
        parts = self.parts(value)
        options = self.options(value, parts)
        codes, places, countries, remote = set(), [], [], []
        unknown = []
        for text, plain in parts:
            code = self.country(text) or self.country(plain)
            if code:
                codes.add(code)
        for option in options:
            for phrase in dict.fromkeys(option):
                hits = self.near(phrase)
                if hits:
                    for d, e in hits:
                        {"country": countries, "remote": remote}.get(self.kind[e], places).append((d, e))
                    break
        if places:
            best = min(places, key=lambda h: (h[0], bool(codes) and self.code[h[1]] not in codes, h[1]))
            return best[1]
        if countries:
            # A country beside a town that isn't in the list means that town.
            for text, plain in parts:
                if plain and not self.country(text) and not self.country(plain) and not any(self.kind[e] == "remote" for _, e in self.near(plain)) and whole not in self.names:
                    unknown.append(plain)
            if not unknown:
                return min(countries)[1]
            return 0
        return min(remote)[1] if remote else 0


def gazetteer(catalogue: DataFrame) -> Gazetteer:
    columns = ("location_id", "label", "kind", "country_code", "country_name", "aliases")
    return Gazetteer([tuple(r) for r in catalogue.select(*columns).filter("location_id is not null and label is not null").limit(MAX_ENTRIES + 1).collect()])


def resolver(index: Gazetteer):
    """A column function: location text to location_id."""

    @F.pandas_udf("bigint")
    def resolve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if v is None or not v.strip() else index.resolve(v) for v in s], dtype="Int64")

    return resolve


def _apart(values: DataFrame, column: str) -> DataFrame:
    """Distinct values in as many partitions as there are cores, or more if the session shuffles into more; by number, so
    that small ones aren't put together again before the slow search."""
    spark = values.sparkSession
    return values.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), column)


def resolved(df: DataFrame, catalogue: DataFrame, column: str, out: str = "location_id") -> DataFrame:
    """``df`` with the id of the entry meant by ``column``. Each distinct value is searched once and looked up again."""
    values = df.select(F.col(column).cast("string").alias("__value")).filter("__value is not null").distinct()
    answers = _apart(values, "__value").select("__value", resolver(gazetteer(catalogue))("__value").alias(out))
    return lookup(df.withColumn("__value", F.col(column).cast("string")), cut_lineage(answers), "__value").drop("__value")


def candidates(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(value, location_id, distance) of every entry within the distance of a phrase of each distinct value."""
    index = gazetteer(catalogue)

    @F.pandas_udf("array<struct<distance:int,location_id:bigint>>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"distance": d, "location_id": e} for d, e in index.within(v)] for v in s])

    rows = _apart(values.select("value").filter(F.col("value").rlike(r"(?U)\S")).distinct(), "value")
    return rows.select("value", F.explode(near("value")).alias("c")).select("value", "c.location_id", "c.distance")


def found(jobs: DataFrame, public: DataFrame, catalogue: DataFrame) -> DataFrame:
    """p7_found: distinct non-blank locations that aren't letter for letter a label."""
    rows = jobs.select(F.lit("jobs").alias("source_table"), F.col("id").cast("string").alias("row_key"), F.col("location").alias("value")).unionByName(
        public.select(F.lit("public_postings").alias("source_table"), F.col("source_job_id").alias("row_key"), F.col("location").alias("value"))
    )
    labels = catalogue.select(F.col("label").alias("value")).distinct()
    rows = rows.filter(F.col("value").rlike(r"(?U)\S")).join(labels, "value", "left_anti")
    return resolved(rows, catalogue, "value").select("source_table", "row_key", "location_id").distinct()

"""Text cut off by field limits: censored length distributions together with evidence from the endings.

Lengths: the logarithm of each source's lengths is taken as normal, right-censored where a text reaches the source's
limit. Candidate limits are lengths at which far more texts end than the density of the lengths around explains; the two
parameters are fitted by maximum likelihood (a few steps of expectation and maximisation over a histogram of lengths, in
which the texts at the limit count as "at least this long"). The posterior of a text at a candidate limit is the excess
of its length over the fitted density.

Endings: over all documents it is counted how sentences end, by their first words, and whether a line goes on after its
last words. The last stretch of a text (marks such as "…" or "(more)" and links put aside) so gets the odds of being
complete; a last word that nowhere else stands complete is cut. Both log odds are added.

Both come from one pass over the texts (``measured``): it turns words into 64-bit numbers, so that counts of words and
word sequences are made by array operations and move as two numbers each. The numbers an ending asks for are looked up in
the counts by equality (``tables.lookup``: keys asked by many documents apart), and no text leaves its row. The lengths
of a source meet in one task as a histogram, whose size is bounded by the longest text.

Defined results: null and blank texts aren't cut; a null source is a source of its own; very long texts are read whole;
repeated rows count as often as they occur; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.tables import cut_lineage, lookup, spread

# Marks and links that may follow a cut.
MARK = re.compile(r"(?:\[(?:…|\.\.\.)\]|\((?:more|mehr|suite|más|continued)\)|(?:(?:…|\.\.\.)\s*)?(?:Show|Read|See) more\.?|…|\.\.\.)$")
LONGEST_MARK = 16
LINK = re.compile(r"\s*(?:[^\W\d_][\w ]{0,20}[:>-]\s*)?https?://\S+$")
SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\W\d_a-z])")
ENDING = (".", "!", "?", ".)", "!)", "?)", ":", ".\"", ".”")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: The log odds above which a text counts as cut.
LEAST_ODDS = 0.0
#: Characters that are turned into numbers at once; bounds the memory of a task, changes no count.
AT_ONCE = 2_000_000


def token(word: str, first: bool) -> str:
    """A word with its punctuation; numbers and names of things are classes, except at the start."""
    if first and word in {"-", "*", "•", "▪"}:
        return "•"
    word = NUMBER.sub("0", word)
    return word if first or not word[:1].isupper() else "X" + re.sub(r"[\w+#-]", "", word)


def bare(word: str) -> str:
    return word.strip(".,;:!?()[]*\"'“”…").casefold()


def _without_marks(body: str) -> str:
    """A text without the marks at its end; a text that is nothing else keeps them."""
    out = body
    while True:
        at = max(0, len(out) - LONGEST_MARK)
        m = MARK.search(out, at)
        if not m:
            return out
        cut = out[: m.start()].rstrip()
        if not cut:
            return body
        out = cut


def split_end(text: str) -> tuple[str, str, bool]:
    """The text without its last stretch, the last sentence or line, and whether a mark of a cut followed it."""
    body, marked = text.rstrip(), False
    for _ in range(3):
        line_at = body.rfind("\n")
        cut = body
        if line_at >= 0 and LINK.match(body, line_at):
            cut = body[:line_at].rstrip()
        else:
            word = body.rsplit(None, 1)[-1] if body else ""
            if len(word) < len(body) and word.startswith(("http://", "https://")):
                cut = body[: len(body) - len(word)].rstrip()
        bare_cut = _without_marks(cut)
        marked = marked or bare_cut != cut
        if bare_cut == body or not bare_cut:
            break
        body = bare_cut
    line = body.rsplit("\n", 1)[-1]
    last = SENTENCE.split(line)[-1].strip()
    return body[: len(body) - len(last)], last, marked


def complete(stretch: str) -> bool:
    """Whether a stretch ends the way only complete ones do: with a full stop, a sign that isn't a word, or as hashtags."""
    return stretch.endswith(ENDING) or stretch.startswith("#") or not (stretch[-1:].isalnum() or stretch[-1:] in "+#-/&,'’…")


def stretches(text: str) -> list[str]:
    return [s for line in text.split("\n") for s in map(str.strip, SENTENCE.split(line)) if s]


def number(word: str) -> int:
    """The same 64-bit number in every process; never 0, which stands for no word."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1


def key(kind: str, *parts: np.ndarray) -> np.ndarray:
    """The numbers of sequences of words; their order counts."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15 ^ (ord(kind) << 32), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


BULLET = np.uint64(number("•"))


class Words:
    """The words of many stretches as numbers: ``token`` (by place in the stretch) and ``bare``, with the bounds of the stretches."""

    def __init__(self, all_stretches: list[str]) -> None:
        split = [s.split() for s in all_stretches]
        self.size = np.fromiter(map(len, split), np.int64, len(split))
        self.stop = np.fromiter((s.endswith(ENDING) for s in all_stretches), bool, len(split))
        code, words = pd.factorize(np.array([w for s in split for w in s], dtype=object))
        as_numbers = lambda f: np.fromiter((number(f(w)) for w in words), np.uint64, len(words))
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.stretch = np.repeat(np.arange(len(split)), self.size)
        self.place = np.arange(len(code)) - self.begin[self.stretch]
        self.token = as_numbers(lambda w: token(w, False))[code] if len(code) else np.zeros(0, np.uint64)
        heads = self.begin[self.size > 0]
        first = {c: number(token(words[c], True)) for c in set(code[heads].tolist())}
        self.token[heads] = np.fromiter((first[c] for c in code[heads].tolist()), np.uint64, len(heads))
        self.bare = as_numbers(bare)[code] if len(code) else np.zeros(0, np.uint64)

    def back(self, at: np.ndarray, steps: int) -> np.ndarray:
        """The word so many places before, 0 beyond the start of the stretch."""
        return np.where(self.place[at] >= steps, self.token[np.maximum(at - steps, 0)], np.uint64(0))

    def context(self, kind: str, at: np.ndarray) -> np.ndarray:
        """The three words up to these; those of list items apart."""
        item = np.where(self.token[self.begin[self.stretch[at]]] == BULLET, BULLET, np.uint64(0))
        return key(kind, item, self.back(at, 2), self.back(at, 1), self.token[at])

    def start(self, kind: str, s: np.ndarray, words: int) -> np.ndarray:
        second = np.where(self.size[s] > 1, self.token[np.minimum(self.begin[s] + 1, max(0, len(self.token) - 1))], np.uint64(0))
        return key(kind, self.token[self.begin[s]], second if words > 1 else np.zeros(len(s), np.uint64))

    def outline(self, s: np.ndarray) -> np.ndarray:
        """How stretches begin and end."""
        last = self.end[s] - 1
        second = np.where(self.size[s] > 1, self.token[np.minimum(self.begin[s] + 1, max(0, len(self.token) - 1))], np.uint64(0))
        return key("L", self.token[self.begin[s]], second, self.back(last, 2), self.back(last, 1), self.token[last])


def _counts(texts: list[tuple[str, str, bool]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of split texts the keys that are counted, and the six keys that each text's last stretch asks for: how stretches
    begin and whether they end with a full stop (S, P), their last three words (E), three words before others (M), words
    before others (W), outlines of last stretches (L)."""
    inner = [stretches(before) for before, _, _ in texts]
    flat = [s for part in inner for s in part]
    n = len(flat)
    w = Words(flat + [last for _, last, _ in texts])
    full = np.flatnonzero(w.size[:n] > 0)
    begins = np.flatnonzero((np.arange(len(w.size)) >= n) & (w.size > 0))
    ends = w.end[full] - 1
    closed = np.array([complete(last) for _, last, _ in texts], bool)
    is_end = np.zeros(len(w.token), bool)
    is_end[w.end[w.size > 0] - 1] = True
    of_last = w.stretch >= n
    said = ~is_end | ~of_last
    said[w.end[begins] - 1] = closed[begins - n]
    one, two = w.start("S", full, 1), w.start("S", full, 2)
    longer = w.size[full] > 1
    stops = w.stop[full]
    counted = [one, two[longer], w.start("P", full[stops], 1), w.start("P", full[stops & longer], 2), w.context("E", ends), w.context("M", np.flatnonzero(~is_end)), key("W", w.bare[said]), w.outline(begins)]
    asked = np.zeros((len(texts), 6), np.uint64)
    at = w.end[begins] - 1
    asked[begins - n] = np.stack([w.start("S", begins, 2), w.start("P", begins, 2), w.context("E", at), w.context("M", at), key("W", w.bare[at]), w.outline(begins)], 1)
    return counted, asked


MEASURED = "doc_id bigint, source string, h bigint, closed boolean, marked boolean, body bigint, keys array<bigint>, k bigint, n bigint"


def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a text: whether it closes, whether a mark follows, its length before marks and the keys it asks for; then
    the counts of all keys in the batch (``k``, ``n``), added up before they are shuffled."""
    for pdf in frames:
        ends = [split_end(t) for t in pdf["text"]]
        counted, asked = [], []
        at = 0
        while at < len(ends):
            to, room = at, AT_ONCE
            while to < len(ends) and (room > 0 or to == at):
                room -= len(ends[to][0]) + len(ends[to][1])
                to += 1
            c, a = _counts(ends[at:to])
            k, n = np.unique(np.concatenate(c), return_counts=True)
            counted.append((k, n))
            asked.append(a)
            at = to
        if ends:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "source": pdf["source"], "h": pdf["h"].astype("Int64"), "closed": [complete(e[1]) for e in ends], "marked": [e[2] for e in ends], "body": [len(e[0]) + len(e[1]) for e in ends],
                                "keys": list(np.concatenate(asked).view(np.int64)), "k": pd.array([None] * len(ends), "Int64"), "n": pd.array([None] * len(ends), "Int64")})
        if counted:
            k, back = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in counted])).astype(np.int64)
            none = [None] * len(k)
            yield pd.DataFrame({"doc_id": pd.array(none, "Int64"), "source": none, "h": pd.array(none, "Int64"), "closed": none, "marked": none, "body": pd.array(none, "Int64"), "keys": none, "k": k.view(np.int64), "n": n})


def fit_censored(hist: pd.DataFrame, rounds: int = 12, least: int = 8, ratio: float = 6.0) -> pd.DataFrame:
    """The limits of one source and the posterior that a text of that length was cut, from its lengths (length, n).

    A candidate limit holds at least ``least`` texts and ``ratio`` times the mean of the lengths within 32 of it. The log
    lengths are normal, right-censored at the candidates: expectation and maximisation with the mean and variance of the
    truncated tail. The posterior is the share of a candidate's texts beyond the fitted density.
    """
    hist = hist[hist["length"] > 0]
    length, n = hist["length"].to_numpy(float), hist["n"].to_numpy(float)
    order = np.argsort(length)
    length, n = length[order], n[order]
    total = np.concatenate([[0], np.cumsum(n)])
    low, high = np.searchsorted(length, length - 32), np.searchsorted(length, length + 32, side="right")
    around = (total[high] - total[low] - n) / 64
    spike = (n >= least) & (n >= ratio * np.maximum(around, 0.25))
    x = np.log(length)
    mean, var = np.average(x, weights=n), max(np.cov(x, fweights=n.astype(int)) if n.sum() > 1 else 1.0, 1e-3)
    for _ in range(rounds if spike.any() else 0):
        sd = math.sqrt(var)
        z = (x - mean) / sd
        tail = np.maximum(0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in z]), 1e-9)
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        first = np.where(spike, mean + sd * hazard, x)
        second = np.where(spike, var * (1 + z * hazard - hazard**2) + (mean + sd * hazard) ** 2, x * x)
        mean = np.average(first, weights=n)
        var = max(np.average(second, weights=n) - mean**2, 1e-3)
    density = np.exp(-((x - mean) ** 2) / (2 * var)) / math.sqrt(2 * math.pi * var) / length * n.sum()
    expected = np.minimum(np.maximum(density, around), n)
    out = pd.DataFrame({"length": length.astype("int64"), "posterior": np.clip(1 - expected / n, 0.0, 1.0)})
    return out[spike & (out["posterior"].to_numpy() > 0)]


def limits(docs: DataFrame) -> DataFrame:
    """(source, body, posterior) from the lengths of all texts; a source's histogram is as long as its longest text at most."""
    hist = docs.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.col("body").alias("length")).agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_censored(pdf).assign(source=pdf["source"].iloc[0])[["source", "length", "posterior"]]

    return hist.groupBy("source").applyInPandas(fit, "source string, length bigint, posterior double").withColumnRenamed("length", "body")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, odds, posterior): one row for each row with text."""
    texts = spread(documents.select("doc_id", "source", "text").filter(F.col("text").rlike(r"(?U)\S")), "doc_id")
    rows = texts.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("h"), "text")
    both = cut_lineage(rows.mapInPandas(measured, MEASURED))
    counts = both.filter("k is not null").groupBy("k").agg(F.sum("n").alias("n"))
    docs = both.filter("k is null").drop("k", "n")
    keyed = docs.filter(~F.col("closed")).select("doc_id", "h", F.posexplode("keys").alias("which", "k")).distinct()
    found_counts = lookup(keyed, counts, "k").groupBy("doc_id", "h").agg(*(F.coalesce(F.max(F.when(F.col("which") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in enumerate("SPEMWL")))
    rows = docs.drop("keys").join(found_counts, ["doc_id", "h"], "left").join(limits(docs), ["source", "body"], "left").fillna(0, list("SPEMWL")).fillna(0.0, ["posterior"])
    unknown = F.when(F.col("W") == 0, 3.0).otherwise(0.0)
    line_end = F.log((F.col("M") + 0.5) / (F.col("E") + 0.5))  # a phrase that always goes on, or never does
    ending = (
        F.when(F.col("closed"), -8.0)
        .when((F.col("S") >= 2) & (F.col("P") >= 0.5 * F.col("S")), 2.0 + F.log((F.col("P") + 0.5) / (F.col("S") - F.col("P") + 0.5)) + unknown)
        .when((F.col("S") < 2) & (F.col("L") >= 3), -F.log(F.col("L").cast("double")) - 1.0)
        .when(F.col("E") > 0, line_end - 1.0)
        .otherwise(line_end + unknown)
    )
    prior = F.log((F.col("posterior") + 0.02) / (1.02 - F.col("posterior"))) + F.when(F.col("marked"), 3.0).otherwise(0.0)
    odds = ending + F.least(F.greatest(prior + 3.0, F.lit(0.0)), F.lit(3.0))
    return rows.select("doc_id", F.nullif("source", F.lit("")).alias("source"), (odds > LEAST_ODDS).alias("cut"), odds.alias("odds"), "posterior")


def found(documents: DataFrame) -> DataFrame:
    """p10_found: distinct documents whose text was cut."""
    return judged(documents).filter("cut").select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """How often each source cuts its texts."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))

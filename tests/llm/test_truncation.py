from collections import Counter

import numpy as np
import pandas as pd
import pytest

from vacantia.llm import truncation as T

SENTENCE = "We keep {} devices connected and need someone to test their data models."
BULLET = "- Working knowledge of {} and data models"


@pytest.fixture()
def docs(spark):
    rows = [(k, "board", f"{SENTENCE.format(k)}\n{BULLET.format('Java')}\n{SENTENCE.format(k + 1)}", 1) for k in range(30)]
    rows += [(100, "board", SENTENCE.format(5) + "\n" + SENTENCE.format(7)[:33], 1), (101, "board", SENTENCE.format(5) + "\nWe kee… Show more", 1), (102, "board", SENTENCE.format(5) + "\n" + BULLET.format("Go"), 1), (103, None, SENTENCE.format(5) + "\n- Working knowledge of Java and da", 1), (104, "x", None, 1), (105, "x", "  ", 1), (106, "x", SENTENCE.format(8) + "\nApply: https://a.example/1", 1), (107, "x", SENTENCE.format(8)[:40] + "\nRead on: https://a.example/1", 1), (100, "board", SENTENCE.format(5) + "\n" + SENTENCE.format(7)[:33], 1)]
    rows += [(200 + k, "board", SENTENCE.format(k) + "\nGood luck", 1) for k in range(4)] + [(300, "long", SENTENCE.format(1) + " " + "word " * 30_000 + "end.", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, cut int")


def test_found(docs):
    assert {r.doc_id for r in T.found(docs).collect()} == {100, 101, 103, 107}


def test_counts_against_a_version_with_strings(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["We", "need", "2", "3,5", "Java", "- ", "•", "people.", "Tel:", "#go", "end", "(x)", "\n", "Über"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(60)]
    texts = [t for t in texts if t.strip()]
    want = Counter()
    for text in texts:
        before, last, _ = T.split_end(text)
        split = lambda s: [T.token(w, not k) for k, w in enumerate(s.split())]
        context = lambda t, k: ("item" if t[0] == "•" else "", *([""] * 2 + t)[k : k + 3])
        for s in T.stretches(before):
            t = split(s)
            for start in {tuple(t[:2]), (t[0],)}:
                want["S", start] += 1
                want["P", start] += s.endswith(T.ENDING)
            want["E", context(t, len(t) - 1)] += 1
            want.update(("M", context(t, k)) for k in range(len(t) - 1))
            want.update(("W", T.bare(w)) for w in s.split())
        t = split(last)
        want.update(("M", context(t, k)) for k in range(len(t) - 1))
        want.update(("W", T.bare(w)) for w in (last.split() if T.complete(last) else last.split()[:-1]))
        want["L", tuple(t[:2]), tuple(t[-3:])] += 1 if t else 0
    frame = pd.DataFrame({"doc_id": range(len(texts)), "source": "s", "h": 0, "text": texts})
    for room in (T.AT_ONCE, 50):
        monkeypatch.setattr(T, "AT_ONCE", room)
        docs, counts = T.measured(iter([frame]))
        assert sorted(counts["n"]) == sorted(n for n in want.values() if n) and len(docs) == len(texts)


def test_rates_and_empty(docs):
    got = {r.source: (r.texts, r.cut) for r in T.rates(docs).collect()}
    assert got["board"] == (38, 3) and got[None] == (1, 1) and got["x"] == (2, 1)
    assert T.found(docs.limit(0)).count() == 0


def test_limit_of_a_censored_sample():
    rng = np.random.default_rng(1)
    true = np.exp(rng.normal(6, 0.7, 20_000)).astype(int) + 1
    seen = np.minimum(true, 700)
    length, n = np.unique(seen, return_counts=True)
    out = T.fit_censored(pd.DataFrame({"length": length, "n": n}))
    assert out["length"].tolist() == [700] and out["posterior"].iloc[0] > 0.97

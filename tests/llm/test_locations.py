import random

import pytest
from pyspark.sql import functions as F

from vacantia.llm import locations as L

ENTRIES = [(1, "Remote", "remote", None, None, ["Telework"]), (2, "Norvania", "country", "XA", "Norvania", []), (3, "Estellin", "country", "XB", "Estellin", None), (4, "Upper Koregrir", "city", "XA", "Norvania", []), (5, "Lower Koregrir", "city", "XA", "Norvania", []), (6, "Peberis", "city", "XA", "Norvania", []), (7, "Peberis", "city", "XB", "Estellin", []), (8, "Saint Bogotas", "city", "XB", "Estellin", ["Zawoher City"])]
CASES = {"REMOTE": 1, "100% remote": 1, "work from home": 1, "Telewrok": 1, "All of Norvania": 2, "Norvnia": 2, "Estellin (nationwide)": 3, "uppr koregrir": 4, "Koregrir, Lower": 5, "LowerKoregrir": 5, "Peberis, XB": 7, "Estellin - Peberis": 7, "Pebreis, Norvania": 6, "12345 Peberis": 6, "St. Bogotas": 8, "Saint Bógotas [office]": 8, "Zawoher City": 8, "near Saint Bogotas": 8, "Hill Park, Saint Bogotas": 8, "Saint Bogotas, North District, Estellin": 8, "Client site": 0, "n/a": 0, "Dagarod, Estellin": 0, "Port Tamavir": 0, "x" * 5000: 0, "-": 0}


def brute(a, b):
    """Edits between two strings, swapped neighbours counting as one."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_cases():
    g = L.Gazetteer(ENTRIES)
    assert {v: g.resolve(v) for v in CASES} == CASES


def test_automaton_against_all_distances():
    rng = random.Random(7)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    trie = L.Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(150):
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        for most in (0, 1, 2):
            assert trie.search(q, most) == sorted((brute(q, w), i) for i, w in enumerate(words) if brute(q, w) <= most), (q, most)


def test_table(spark):
    catalogue = spark.createDataFrame(ENTRIES, "location_id bigint, label string, kind string, country_code string, country_name string, aliases array<string>")
    jobs = spark.createDataFrame([(1, "pebreis, xb", 9), (2, None, 9), (3, "  ", 9), (4, "Peberis", 9), (5, "HQ", 9), (5, "HQ", 9)], "id bigint, location string, location_id int")
    public = spark.createDataFrame([], "source_job_id string, location string")
    assert sorted(tuple(r) for r in L.found(jobs, public, catalogue).collect()) == [("jobs", "1", 7), ("jobs", "5", 0)]
    got = L.resolved(jobs.drop("location_id"), catalogue, "location", "place").orderBy("id").collect()
    assert [r.place for r in got] == [7, None, None, 6, 0, 0]
    assert L.resolved(jobs, catalogue.filter(F.lit(False)), "location", "place").filter("place <> 0").count() == 0


def test_long_values_are_read():
    g = L.Gazetteer(ENTRIES)
    assert g.resolve("All of Norvania" + " " * 400) == 2 and g.resolve("uppr koregrir, " + "x" * 400) == 4


def test_candidates_against_all_distances(spark):
    rng = random.Random(3)
    labels = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(60)})
    entries = [(k, w, "city", "XA", "Norvania", []) for k, w in enumerate(labels)]
    catalogue = spark.createDataFrame(entries, "location_id bigint, label string, kind string, country_code string, country_name string, aliases array<string>")
    values = [w[:-1] + "x" for w in labels] + ["", None, labels[0], labels[0]]
    got = {tuple(r) for r in L.candidates(spark.createDataFrame([(v, 0) for v in values], "value string, distance int"), catalogue).collect()}
    want = {(v, k, brute(v, w)) for v in set(values) if v for k, w in enumerate(labels) if brute(v, w) <= L.allowed(len(v))}
    assert got == want


def test_a_list_too_large_for_the_workers_raises(monkeypatch):
    monkeypatch.setattr(L, "MAX_PATH_CHARACTERS", 20)
    with pytest.raises(ValueError):
        L.Gazetteer(ENTRIES)

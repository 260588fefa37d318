import itertools
import random

from vacantia.llm import employers as E

GROUPS = [
    ["Copper Wovestagat Laboratories", "Copper Wovestagat Laboratories ", "COPPER_WOVESTAGAT_LABORATORIES", "Copper Wovestagqt Laboratories Inc", "Copper Wovesta Laboratories", "CWL (Wovestagat)", "C. Wovestagat Lab.", "Laboratories, Copper Wovestagat", "CopperWovestagatLaboratories", "Wovestagat Ltd", "Copper Wóvestagat Laboratories (HQ)"],
    ["Ninanovom and Ember Solutions", "Ninanovom & Ember Solns", "Ninanovom a. Ember Sol. S.A.", "NES", "NINANOVOMANDEMBERSOLUTIONS"],
    ["Dezesetat Payments", "Dezese - Payments", "Dezesetta Paym. GmbH"],
    ["Dezesetat Technologies", "Dezestat Technologies Inc"],
    ["The Betivotim Holdings Group", "TheBetivotimHoldingsGroup", "TBHG (Betivotim)", "Holdings, The Betivotim Group"],
    ["Zonoklatat International", "Zonoklatat Int'l S.A."],
    ["Fevidazex Anchor Payments", "Fevidazex A. Payments", "A. Fevidazxe Payments"],
]


def test_groups(spark):
    jobs = spark.createDataFrame([(g[0], "x") for g in GROUPS for _ in range(9)] + [(n, "x") for g in GROUPS for n in g] + [(None, "x"), ("", "x"), ("  ", "x"), ("n/a", "x"), ("Confidential", "x")], "company string, employer string")
    other = spark.createDataFrame([("Dezesetat", "y"), ("z" * 900, "y")], "company string, employer string")
    got = {tuple(r) for r in E.found(jobs, other).collect()}
    assert got == {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert E.found(jobs.limit(0), other.limit(0)).count() == 0


def test_near_against_all_distances():
    from test_locations import brute

    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    assert all(E.near(a, b) == (brute(a, b) <= 1) for a in words for b in words)


def test_long_names_are_rewritten():
    rng = random.Random(3)
    words = ["".join(rng.choice("bdkvz") + rng.choice("aeiou") for _ in range(6)) for _ in range(60)]
    name = " ".join(words)
    key, typing, *_ = E.forms(E.parse(name))
    assert len(name) > 400 and E.forms(E.parse(name.upper().replace(" ", "_") + " GmbH"))[0] == key
    assert set(typing) & set(E.forms(E.parse(name.replace(words[7], words[7][:-1])))[1])
    assert max(map(len, typing)) <= E.LONG

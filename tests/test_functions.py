import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantia.functions import analysis as a
from vacantia.functions import text as t


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


URLS = {
    "HTTPS://Jobs.Example.com/a/?utm_source=x&id=1&REF=y#top": "https://jobs.example.com/a?id=1",
    "https://a.example/x).": "https://a.example/x",
    "http://a.example/": "http://a.example/",
    "http://a.example//": "http://a.example",
    "https://a.example/p?flag&&a=b%20c&Utm%5Fx=1&gh_src=2": "https://a.example/p?flag&a=b%20c",
    "https://a.example:443/p": "https://a.example:443/p",
    "https://a.example:99999/p": "",
    "https://user@a.example/": "",
    "ftp://a.example/": "",
    "https://": "",
    "not a url": "",
    "": "",
    "https://a.example/with space?q=1": "https://a.example/with space?q=1",
}


def test_normalize_url(spark):
    assert column(spark, [*URLS, None], t.normalize_url) == [*URLS.values(), ""]


def test_identities(spark):
    one = column(spark, ["https://A.example/X?ref=1", "https://a.example/x", "nothing", None], t.url_identity)
    assert one[0] == one[1] and one[2] is None and one[3] is None
    same = column(spark, ["Dev", " DEV ", "", None], lambda c: t.position_fingerprint(c, F.lit("Straße"), F.lit("x")))
    assert same[0] == same[1] and same[2] is None and same[3] is None


def test_public_hosts(spark):
    want = {"https://a.example/": True, "http://localhost/": False, "http://10.0.0.1/": False, "http://172.20.1.1/": False, "http://172.32.1.1/": True, "http://[::1]/": False, "http://169.254.1.1/": False, "x": False}
    assert column(spark, list(want), t.is_public_url) == list(want.values())


def test_normal_forms(spark):
    text = "  Straße–C++ &  ﬁt’s \n`x` "
    assert column(spark, [text, None, ""], t.fingerprint_text) == ["strasse–c++ & fit’s `x`", "", ""]
    assert column(spark, [text], t.analysis_text) == ["strasse-c++ & fit's 'x'"]
    assert column(spark, [text, "a_b/c (d)"], t.scoring_text) == ["strasse–c fits x", "a b c d"]
    assert column(spark, ["a  b\r\n\r\na b\nc\t c\nc c", None], t.page_text) == ["a b\nc c", ""]


def test_lines_and_dates(spark):
    assert column(spark, ["Dev @ x @ Acme", "Dev", " @ "], lambda c: t.split_title_and_company(c)[0]) == ["Dev @ x", "Dev", ""]
    assert column(spark, ["Location: a\nlocation:  b \nx", "x"], lambda c: t.labelled(F.split(c, "\n"), "location")) == ["b", None]
    assert column(spark, ["1-2-2025", "01/02/2025", "2025-02-01", "2025-13-01", "x"], t.posted_date) == [date(2025, 2, 1)] * 3 + [None, None]
    assert column(spark, ["2025-01-01", "2025-01-22T1", "2025-01-23", "x"], lambda c: t.dates_nearby(c, F.lit("2025-01-01"))) == [True, True, False, False]
    assert column(spark, ["mail a@b.example or +1 202 555 0100", "- Job ID: 1234567890"], t.scrub_contacts) == ["mail or", "Job ID: 1234567890"]
    assert column(spark, ['["a", 1]', "{}", "x", None], t.json_strings) == [["a", "1"], [], [], []]


def test_phrases(spark):
    text = ["c++ and node.js", "cc++", "xnode.js", "go"]
    assert column(spark, text, lambda c: t.phrase(c, "c++", "node.js")) == [True, False, False, False]
    assert column(spark, ["größe x", "größ"], lambda c: t.keyword(c, "größ")) == [False, True]
    assert column(spark, ["spring boot and java", "spring boot, spring", "spring framework"], a.technologies) == [["Java", "Spring Boot"], ["Spring", "Spring Boot"], ["Spring"]]


def slow_candidates(text):
    """The rules of experience, row by row."""
    out = [(0, 0)] if re.search(a.NONE_NEEDED, text) else []
    ctx = re.compile("(?<![a-z0-9])(?:" + "|".join(map(re.escape, a.EXPERIENCE_CONTEXT)) + ")(?![a-z0-9])")
    parts = [f.strip() for f in re.split(r"(?<=[.!?;])\s+|\s+[•●▪]\s+", text) if f.strip() and ctx.search(f)]
    for f in parts:
        out += [tuple(sorted((int(x), int(y)))) for x, y in re.findall(a.RANGE, f)]
    for f in parts:
        out += [(int(x), None) for p in a.OPEN_ENDED for x in re.findall(p, f)]
    return {(x, y) for x, y in out if (x if y is None else y) <= 20}


PHRASES = ["3+ years of experience.", "2-5 years with java", "at least 4 years", "minimum of 7 yrs", "no prior experience required;", "10 to 8 years in development", "30+ years", "software", "5 years of relevant experience", "1 year", "• required", "hello."]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PHRASES), max_size=6), min_size=5, max_size=25))
def test_experience_against_slow_rules(spark, rows):
    texts = [" ".join(r) for r in rows]
    got = column(spark, texts, a.experience_candidates)
    assert [{(c.low, c.high) for c in r} for r in got] == [slow_candidates(x) for x in texts]
    best = column(spark, texts, a.experience)
    assert [(b.low, b.high) for b in best] == [max(slow_candidates(x), key=lambda c: (c[0], 99 if c[1] is None else c[1]), default=(None, None)) for x in texts]


@pytest.mark.parametrize("signals,low,label", [(["student", "senior"], 9, "student"), (["senior", "junior"], 1, "senior"), ([], None, "not-specified"), ([], 1, "entry-level"), ([], 3, "junior-to-mid"), ([], 5, "mid-level"), ([], 6, "senior")])
def test_labels(spark, signals, low, label):
    row = spark.range(1).select(a.experience_label(F.lit(low).cast("int"), F.array(*map(F.lit, signals)).cast("array<string>")).alias("x")).first()
    assert row.x == label


def test_analysis_row(spark):
    df = spark.createDataFrame([(1, "Senior developer. At least 3 years of experience with Python and Docker. Bachelor's degree required."), (2, None)], "i int, d string")
    one, two = a.analysed(df, "d").orderBy("i").collect()
    assert (one.experience_min, one.experience_max, one.experience_label, one.technologies, one.seniority_signals) == (3, None, "senior", ["Python", "Docker"], ["senior"])
    assert one.education_signals == ["degree-required", "degree-mentioned"] and one.analysis_confidence == 0.75
    assert (two.experience_min, two.technologies, two.analysis_confidence) == (None, [], 0.35)

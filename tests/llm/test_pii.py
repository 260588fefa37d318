import numpy as np
import pytest

from vacantia.llm import pii
from vacantia.llm import pii_net as net
from vacantia.llm.pii_text import pieces, settle

TEXT = "🔥 New position 🔥\nData Engineer\nCompany - Copper Dudolomir\nSprich mit Karin Ostvatti, Tel. +44 20 7946 0860. Send your CV to mira+jobs@post.example.net.\nMy details: Hugo Fenkiborg; 178 rue des Amsels, 19631 Hevemid; +33 1 99 00 18 03; ID number: 000-64-7164\nRef. no. 857178976\nhttps://jobs.dudolomir.example/job/1?ref=chat"
WANT = [("Karin Ostvatti", "name"), ("+44 20 7946 0860", "phone"), ("mira+jobs@post.example.net", "email"), ("Hugo Fenkiborg", "name"), ("178 rue des Amsels, 19631 Hevemid", "address"), ("+33 1 99 00 18 03", "phone"), ("000-64-7164", "id_number")]


def test_gradients_against_differences():
    m = net.new_model(4, 1)
    x, lengths = net.codes(["ab Cd", "x0", "hello wor"])
    gold = np.random.default_rng(0).integers(0, net.K, x.shape)
    g = net.gradients(m, x, lengths, gold)[1]
    for p in m:
        at = tuple(np.unravel_index(np.abs(g[p]).argmax(), m[p].shape))
        values = []
        for step in (1e-2, -1e-2):
            other = {k: v.copy() for k, v in m.items()}
            other[p][at] += step
            values.append(net.gradients(other, x, lengths, gold)[0])
        assert np.asarray(g[p])[at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=2e-2)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    m = {"A": rng.normal(size=(net.K, net.K)), "s": rng.normal(size=net.K), "e": rng.normal(size=net.K)}
    e = rng.normal(size=(1, 4, net.K))
    paths = np.stack(np.meshgrid(*[np.arange(net.K)] * 4, indexing="ij"), -1).reshape(-1, 4)
    score = m["s"][paths[:, 0]] + m["e"][paths[:, 3]] + e[0, np.arange(4), paths].sum(1) + m["A"][paths[:, :-1], paths[:, 1:]].sum(1)
    assert (net.viterbi(m, e, np.array([4]))[0] == paths[score.argmax()]).all()


def test_decoder_is_exact():
    m = net.load()
    shaped = [w for _, w in pieces(net.shape(TEXT), TEXT)]
    x, lengths = net.codes(shaped)
    want = net.viterbi(m, net.emissions(m, x, lengths), lengths)
    assert (net.Decoder(m).tags(x, lengths) == want).all()


def test_known_text():
    got = pii.Finder().find([TEXT])[0]
    assert [(TEXT[a:b], k) for a, b, k in got] == WANT


def test_long_text_without_breaks_is_read_whole():
    text = "we automate the alert rules and publish notes about it, " * 40 + "ask for Karin Ostvatti or write mira@post.example.net, thanks, " + "we automate the alert rules and publish notes about it, " * 40
    got = [text[a:b] for a, b, _ in pii.Finder().find([text])[0]]
    assert "mira@post.example.net" in got and any("Ostvatti" in x for x in got)


def test_addresses_inside_of_web_addresses_and_long_ones():
    text = "Apply: https://x.example/?contact=anna.kolvan@mail.example today\nSee https://jobs.x.example/1?ref=chat"
    assert [text[a:b] for a, b, k in pii.Finder().find([text])[0] if k == "email"] == ["anna.kolvan@mail.example"]
    long = "write to " + "anna." * 30 + "kolvan@mail.example today"
    at = long.index("kolvan")
    assert long[slice(*settle(long, at, at + 12, "email"))] == "anna." * 30 + "kolvan@mail.example"


def test_spans_without_a_listed_form_keep_their_borders():
    text = "Vieni in Via Garibaldi 12, 20121 Milano, oggi"
    at = text.index("Via")
    assert text[slice(*settle(text, at, at + 31, "address"))] == "Via Garibaldi 12, 20121 Milano" and settle("at the station", 3, 10, "address") is None


def test_table(spark):
    posts = spark.createDataFrame([(1, TEXT, 5), (2, None, 5), (3, "", 5), (1, TEXT, 5)], "id bigint, raw_text string, start_pos int")
    messages = spark.createDataFrame([("g", "7", "~ Zoe Velmuling"), ("g", "8", "Zeti Hiring Desk")], "source_group string, source_message_id string, sender string")
    rows = {tuple(r) for r in pii.found(posts, messages).collect()}
    assert ("source_messages", "g/7", 3, 15, "name") in rows and not any(r[1] == "g/8" for r in rows)
    assert {(TEXT[a - 1 : b], k) for t, _, a, b, k in rows if t == "job_postings"} == set(WANT)
    out = posts.select("id", pii.redacted("raw_text").alias("t")).orderBy("id").collect()
    assert "Tel. [PHONE]. Send your CV to [EMAIL].\nMy details: [NAME]; [ADDRESS]; [PHONE]; ID number: [ID_NUMBER]\nRef. no. 857178976\nhttps" in out[0].t
    assert (out[2].t, out[3].t) == (None, "")
    assert pii.found(posts.limit(0), messages.limit(0)).count() == 0

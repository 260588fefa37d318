import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vacantia.llm import mixing as M
from vacantia.llm import packing as P
from vacantia.llm.tokenizer import VOCABULARY, encoding


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c"]), " ".join(rng.choice(["word", "Straße", "jobs", "Ω", "2025"]) for _ in range(rng.randint(1, 120))), 0) for k in range(400)]
    rows += [(900, "a", None, 0), (901, "a", "", 0), (902, None, "orphan text", 0), (903, "b", "long " * 1500, 0), (5, "a", "again", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, part int")


def exact(docs):
    enc = encoding(open(VOCABULARY, "rb").read())
    return [(r.doc_id, r.source, len(enc.encode_ordinary(r.text))) for r in docs.collect() if r.text]


def test_best_fit_against_slow_version():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        slow: list[list[int]] = []
        for s in sorted(sizes, reverse=True):
            fits = [b for b in slow if sum(b) + s <= capacity]
            max(fits, key=sum).append(s) if fits else slow.append([s])
        got = P.best_fit(sizes, capacity)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(map(sum, slow))


@pytest.mark.parametrize("items,waste", [(40, 1.08), (20_000, 1.0)])  # several rounds of tiny partitions, and one
def test_packing_keeps_every_token(spark, docs, monkeypatch, items, waste):
    monkeypatch.setattr(P, "PER_PARTITION", items)
    kinds = spark.createDataFrame([("small", 256), ("large", 1000)], "container_kind string, capacity_tokens int")
    rows = P.packed(docs, kinds).collect()
    want = sorted((d, n) for d, _, n in exact(docs))
    for kind, capacity in (("small", 256), ("large", 1000)):
        texts, bins, pieces = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in rows:
            if r.container_kind == kind:
                texts[r.doc_id, r.copy_no] += r.tokens
                bins[r.container_id] += r.tokens
                pieces[r.doc_id, r.copy_no] += 1
        assert sorted((d, n) for (d, _), n in texts.items()) == want
        assert max(bins.values()) <= capacity
        assert all(pieces[k] == -(-texts[k] // capacity) for k in texts)
        assert len(bins) <= waste * -(-sum(bins.values()) // capacity) + 2
    assert P.packed(docs.limit(0), kinds).count() == 0
    assert P.packed(docs, kinds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.packed(docs, kinds.withColumn("capacity_tokens", F.lit(0)))


@pytest.mark.parametrize("low,high,rounds", [(55, 70, 2), (34, 45, 3), (5, 60, 3)])
def test_no_task_gets_more_than_its_share(spark, monkeypatch, low, high, rounds):
    """Items that never or hardly fit together end the rounds instead of meeting in one task."""
    monkeypatch.setattr(P, "PER_PARTITION", 500)
    seen, run = [], P._packed_items
    monkeypatch.setattr(P, "_packed_items", lambda items, counts, n: seen.append((n, items.withColumn("p", F.pmod(F.xxhash64("item", F.lit(n)), F.lit(-(-counts[0] // 500)).cast("bigint"))).groupBy("p").count().agg(F.max("count")).first()[0])) or run(items, counts, n))
    rng = random.Random(2)
    texts = spark.createDataFrame([(k, 0, rng.randint(low * 20, high * 20)) for k in range(4000)], "doc_id bigint, copy_no bigint, tokens bigint")
    kinds = spark.createDataFrame([("k", 2000)], "container_kind string, capacity bigint")
    rows = P._packed(texts, kinds).collect()
    bins = defaultdict(int)
    for r in rows:
        bins[r.container_id] += r.tokens
    assert len(rows) == len({r.doc_id for r in rows}) == 4000 and max(bins.values()) <= 2000
    assert max(n for _, n in seen) < 700 and len(seen) <= rounds + 2
    if low == 5:
        assert sum(bins.values()) / (2000 * len(bins)) > 0.97


def test_two_capacities_of_one_kind(spark, docs):
    kinds = spark.createDataFrame([("k", 100), ("k", 300), (None, 50)], "container_kind string, capacity_tokens int")
    rows = P.packed(docs, kinds).collect()
    want = sum(n for *_, n in exact(docs))
    assert sum(r.tokens for r in rows if r.container_kind == "k") == 2 * want and sum(r.tokens for r in rows if r.container_kind is None) == want


def test_demands():
    assert M.demands([("a", 0.5, 1, 100), ("b", 0.5, 10, 100)], 200.0) == {"a": 100.0, "b": 100.0}
    assert M.demands([("a", 0.9, 1, 100), ("b", 0.1, 10, 100), ("c", 0.0, 5, 10)], 200.0) == {"a": 100.0, "b": 100.0, "c": 0.0}
    assert M.demands([("a", 0.9, 1, 10), ("b", 0.1, 1, 10)], 200.0) == {"a": 10.0, "b": 10.0}


def test_mix(spark, docs):
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 1), ("c", 0.5, 2), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    mix, schedule = M.mixed(docs, targets)
    rows = mix.collect()
    total = sum(n for _, s, n in exact(docs) if s)
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len({(r.doc_id, r.copy_no, r.pass_no) for r in rows}) == len(rows)
    most = {"a": 1, "b": 1, "c": 2}
    assert all(r.pass_no < most[r.source] for r in rows)
    want = {r.source: r.demand for r in schedule.collect()}
    for s in "abc":
        used = sum(r.tokens for r in rows if r.source == s)
        assert want[s] - 1 <= used <= want[s] + 3200
    got = {r.source: r for r in M.shares(mix, schedule).collect()}
    assert got["none"].tokens == 0 and abs(sum(r.actual_share for r in got.values()) - 1) < 1e-4 and total > 0
    assert M.mixed(docs.limit(0), targets)[0].count() == 0

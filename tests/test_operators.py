import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vacantia import tables as tables_module
from vacantia.operators import identity, records, search
from vacantia.operators.search import SearchParams
from vacantia.streaming import incremental

POSTING = "arrival_no bigint, source string, source_group string, source_message_id string, title string, company string, location string, posted_on string, job_url string"


def p(n, mid, title="t", url=None, day=None, source="chat", group="g", company="c", location="l"):
    return (n, source, group, mid, title, company, location, day, url)


def resolve(spark, rows):
    got = identity.resolved(spark.createDataFrame(rows, POSTING)).orderBy("arrival_no").collect()
    return [(r.job_id, r.new_job, r.new_posting) for r in got]


def test_rules(spark):
    rows = [
        p(1, "1", url="https://a.example/1", day="2025-01-01"),
        p(2, "1", url="https://a.example/1", day="2025-01-01"),  # the same posting
        p(3, "2", title="other", url="https://A.example/1?utm_source=x"),  # the same address
        p(4, "3", source="feed", url="https://b.example/9", day="2025-01-20"),  # near in time, another source
        p(5, "4", source="feed", url="https://b.example/10", day="2025-01-21"),  # another requisition of that feed
        p(6, "5", source="web", url="https://c.example/1", day="2025-06-01"),  # too late
        p(7, "6", source="web2"),  # no address: the first job of the position
        p(8, "7", title=None),
        p(9, "8", title=None),
    ]
    assert resolve(spark, rows) == [(1, True, True), (1, False, False), (1, False, True), (1, False, True), (2, True, True), (3, True, True), (1, False, True), (4, True, True), (5, True, True)]
    assert resolve(spark, [p(1, "1")])[0] == (1, True, True)
    assert identity.resolved(spark.createDataFrame([], POSTING)).count() == 0


def test_against_one_replay_of_everything(spark):
    rng = random.Random(5)
    rows = [p(n, str(rng.randint(1, 60)), title=rng.choice(["a", "b", "c", None]), url=rng.choice([None, f"https://x.example/{rng.randint(1, 25)}"]), day=rng.choice([None, f"2025-0{rng.randint(1, 4)}-1{rng.randint(0, 9)}"]), source=rng.choice(["chat", "lever", "web"]), group=rng.choice("gh"), company=rng.choice("vw")) for n in range(1, 161)]
    keyed = {r.arrival_no: r for r in identity.keyed(spark.createDataFrame(rows, POSTING)).collect()}
    state, ids, want = identity.Replay(), {}, []
    for n in sorted(keyed):
        first, new, new_posting = state.add(SimpleNamespace(**keyed[n].asDict()))
        ids.setdefault(first, len(ids) + 1)
        want.append((ids[first], new, new_posting))
    assert resolve(spark, rows) == want


def test_components_of_a_chain(spark):
    rows = spark.createDataFrame([(n, f"k{n // 2}", f"m{(n + 1) // 2}") for n in range(40)] + [(99, "z", None)], "arrival_no bigint, posting_key string, url_key string")
    got = {r.arrival_no: r.component for r in identity.components(rows, ("posting_key", "url_key")).collect()}
    assert set(got[n] for n in range(40)) == {0} and got[99] == 99


def test_records(spark):
    log = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "x"), (1, 3, None, None), (2, 1, "c", None), (2, 2, "gone", None)], "k int, n int, v string, w string")
    assert sorted(tuple(r) for r in records.latest_non_null(log, ["k"], F.col("n"), ["v", "w"]).collect()) == [(1, "b", "x"), (2, "gone", None)]
    assert [tuple(r) for r in records.with_tombstones(log, ["k"], [F.desc("n")], F.coalesce(F.col("v") == "gone", F.lit(False))).collect()] == [(1, 3, None, None)]
    new = spark.createDataFrame([(2, "n", 5), (3, "m", 6)], "k int, v string, extra int")
    assert sorted(tuple(r) for r in records.upsert(log.select("k", "v").filter("n = 1"), new.select("k", "v"), ["k"]).collect()) == [(1, "a"), (2, "n"), (3, "m")]
    assert "extra" in records.upsert(log.select("k", "v"), new, ["k"]).columns
    assert {r.k for r in records.insert_missing(log.select("k"), new, ["k"]).collect()} == {3}
    urls = spark.createDataFrame([(1, 1, "u1", "chat"), (1, 2, "u2", "Lever"), (1, 3, "u3", "chat"), (2, 1, None, "chat"), (2, 2, "u5", "chat"), (3, 1, "", "lever")], "j int, i int, u string, s string")
    assert sorted(tuple(r) for r in records.preferred_url(urls, "j", "u", "s", "i").collect()) == [(1, "u2"), (2, "u5"), (3, None)]
    left = spark.range(1).select(records.cooldown_left(F.lit(100), 60, F.lit(130)).alias("a"), records.cooldown_left(F.lit(None).cast("int"), 60, F.lit(130)).alias("b")).first()
    assert tuple(left) == (30, 0)


@pytest.fixture(scope="module")
def tables(spark):
    jobs = spark.createDataFrame([(1, "Data Engineer", "100% Acme", "Oslo", "2025-01-03", 50.0, None, ["Go"]), (2, "QA", None, "OSLO ", "2025-01-02", 80.0, "applied", []), (3, "Dev_Ops", "b\\c", None, "2025-01-01", 20.0, None, ["Rust"])], "id int, title string, company string, location string, first_seen_at string, match_score double, user_status string, technologies array<string>")
    posts = spark.createDataFrame([(1, 1, "chat", None), (2, 1, "lever", "u2"), (3, 1, "chat", "u3"), (4, 3, "web", "u4")], "id int, job_id int, source string, source_message_url string")
    return jobs, posts


def test_search(spark, tables):
    ids = lambda **k: [r.id for r in search.page(*tables, SearchParams(**k)).collect()]
    assert ids() == [1, 2, 3] and ids(sort="score") == [2, 1, 3] and ids(limit=1) == [1]
    assert ids(text="acme") == [1] and ids(text="100%") == [1] and ids(text="c\\") == [] and ids(text="b\\") == [3]
    assert ids(text="d_ta") == [1] and ids(location="oslo") == [1, 2] and ids(technology="rust") == [3]
    assert ids(statuses=("none",)) == [1, 3] and ids(statuses=("all",)) == [1, 2, 3] and ids(least_score=50.0) == [1, 2]
    assert ids(sources=search.normalised_sources(["LEVER ", "all", "", "lever"])) == [1]
    row = search.page(*tables, SearchParams(limit=1)).first()
    assert (row.posting_count, row.sources, row.first_message_url) == (3, "chat,lever", None)
    assert search.total(*tables, SearchParams(limit=1, location="oslo")).first().total == 2
    for bad in ({"sort": "x"}, {"limit": 0}, {"limit": 501}):
        with pytest.raises(ValueError):
            search.page(*tables, SearchParams(**bad))


def test_page_takes_the_top_before_the_join(tables):
    plan = search.page(*tables, SearchParams(limit=2))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_catalogue_and_runs(spark, tables):
    got = search.location_catalogue(tables[0]).collect()
    assert [(r.place, r.label, r.jobs) for r in got] == [("oslo", "OSLO", 2)]
    runs = spark.createDataFrame([("A", 1, "error"), ("a", 2, "success")], "source_id string, run_id int, status string")
    registry = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert sorted(tuple(r) for r in search.latest_runs(runs, registry).collect()) == [("a", "success", 2), ("b", "not_run", None)]


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(i, f"2025-01-01 00:00:{i % 50:02d}", i % 5) for i in range(200)], "event_id bigint, ts string, k int").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "k")
    data.coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    (tmp_path / "e.parquet" / "_SUCCESS").unlink()
    name = next((tmp_path / "e.parquet").glob("part-*.parquet"))
    assert incremental.read_since(spark, str(name), "event_id", 150).count() == 49
    assert incremental.deduplicated(spark, str(name), ["k"]).count() == 5
    assert [r.event_id for r in incremental.bounded_catch_up(data, "event_id", 10, 1).collect()] == [11, 12, 13, 14, 15]
    state = spark.createDataFrame([("g", 300), ("h", 1)], "k string, cursor bigint")
    batch = spark.createDataFrame([("g", 5), ("h", 9), ("i", 2)], "k string, id bigint")
    assert sorted(tuple(r) for r in incremental.advance_cursor(state, batch, "k", "id").collect()) == [("g", 300), ("h", 9), ("i", 2)]
    write, out = incremental.upsert_batch(str(tmp_path / "t"), ["k"]), str(tmp_path / "t")
    for number, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)]]):
        for _ in range(2):  # a repeated batch replaces itself
            write(spark.createDataFrame(rows, "k string, v int"), number)
    assert sorted(tuple(r) for r in incremental.current(spark, out, ["k"]).collect()) == [("a", 2), ("b", 1)]


def test_first_place_of_a_position_is_found_by_day(spark):
    """A hot position: each posting of one feed has its own address, so each is a new job, and none scans all the others."""
    place, state, ids = "p" * 64, identity.Replay(), set()
    for n in range(20_000):
        r = SimpleNamespace(arrival_no=n, source="feed", source_group="g", posted_on=f"{2000 + n % 400 // 4}-01-0{1 + n % 4}", job_url=f"u{n}", posting_key=str(n), url_key=f"k{n}", position_key=place, fallback_key="f")
        ids.add(state.add(r)[0])
    assert len(ids) == 20_000


def test_first_job_of_a_position_within_reach(spark):
    """Against all pairs: days on both sides of 1970 and of every border of spans, unreadable days, several days of one posting."""
    from datetime import date, timedelta

    random.seed(4)
    day = lambda: random.choice(["rolling", None] + [str(date(1969, 11, 1) + timedelta(random.randrange(180))) for _ in range(20)])
    some = lambda n: [(i, random.choice(["Dev", "dev ", "Ops", ""]), "c", random.choice(["x", None]), day()) for i in range(n)]
    jobs, postings = some(40), [(i % 150, *r) for i, *r in some(300)]
    asked, known = spark.createDataFrame(postings, "m int, title string, company string, location string, posted_on string"), spark.createDataFrame(jobs, "id int, title string, company string, location string, posted_on string")
    place = lambda r: (r[1].strip().lower(), r[3])
    dated = lambda rows: [(r[0], place(r), date.fromisoformat(r[4])) for r in rows if r[1] and r[3] and r[4] not in ("rolling", None)]
    for days in (21, 1, 0):
        want = {}
        for m, k, a in dated(postings):
            for i, other, b in dated(jobs):
                if k == other and abs((a - b).days) <= days:
                    want[m] = min(i, want.get(m, i))
        got = identity.by_position(asked, known, ["m"], days).collect()
        assert want and len(got) == len(want) and {r.m: r.job_id for r in got} == want


def test_positions_are_not_broadcast(spark):
    """Spark's estimate of either side is under its threshold here, far below what the side holds."""
    row = [F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("c").alias("company"), F.lit("l").alias("location"), F.expr("cast(date_add(date'2025-01-01', cast(id % 300 as int)) as string)").alias("posted_on")]
    postings, jobs = spark.range(10_000).select(F.col("id").alias("m"), *row), spark.range(20_000).select("id", *row)
    changed = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "1m"}  # a larger broadcast raises
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert identity.by_position(postings, jobs, ["m"]).filter("m = job_id").count() == 10_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dense_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    got = tables_module.numbered(rows, F.col("x").desc(), out="n").collect()
    assert sorted((r.x, r.n) for r in got) == [(x, 999 - x) for x in range(1000)]
    assert tables_module.numbered(rows.limit(0), F.col("x"), out="n").count() == 0


def test_lookup_of_frequent_keys(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}", 1) for k in range(4000)] + [(9000, None, 1), (9001, "unknown", 1)], "i int, k string, n int")
    table = spark.createDataFrame([("hot", "h"), *((f"k{k}", f"v{k}") for k in range(0, 4000, 3))], "k string, v string")
    got = {r.i: r.v for r in tables_module.lookup(rows, table, "k").collect()}
    assert len(got) == 4002 and got[1] == "h" and got[3] == "v3" and got[9000] is None and got[9001] is None
    assert tables_module.lookup(rows.limit(0), table, "k").count() == 0


def test_checkpoint_folder_is_needed_on_a_cluster():
    away = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables_module.checkpoint_dir(away)


def test_since_raises_at_dates_it_cannot_read(spark):
    rows = spark.createDataFrame([(1, "2025-01-02T00"), (2, None), (3, ""), (4, "2024-12-31")], "i int, d string")
    day = F.lit("2025-01-01").cast("date")
    assert [r.i for r in records.since(rows, "d", day).collect()] == [1]
    bad = rows.unionByName(spark.createDataFrame([(5, "02.01.2025")], "i int, d string"))
    assert [r.i for r in records.since(bad, "d", day, strict=False).collect()] == [1]
    with pytest.raises(Exception, match="no ISO date"):
        records.since(bad, "d", day).collect()


def test_runs_summaries_and_polls(spark):
    runs = spark.createDataFrame([(1, "a", 1, 2, "error", 5, 4, 3, 2, "x" * 3000), (2, "b", 1, None, "success", 5, 4, 3, 2, None)], "run_id int, source_id string, started_at int, finished_at int, status string, postings_seen int, postings_relevant int, new_jobs int, new_postings int, error string")
    got = {r.run_id: (r.status, r.at, r.new_jobs, len(r.error or "")) for r in records.run_states(records.run_events(runs)).collect()}
    assert got == {1: ("error", 2, 3, 2000), 2: ("running", 1, 0, 0)}
    with pytest.raises(Exception, match="success or error"):
        records.run_events(runs.withColumn("status", F.lit("done"))).collect()
    stored = spark.createDataFrame([(1, "success", "a"), (2, "no", "a"), (3, "no", "abcd")], "k int, s string, t string")
    new = spark.createDataFrame([(k, "no", "abc") for k in (1, 2, 3, 4)], "k int, s string, t string")
    assert sorted(tuple(r) for r in records.guarded(stored, new, "k", "s", "t", "no").collect()) == [(1, "success", "a"), (2, "no", "abc"), (3, "no", "abcd"), (4, "no", "abc")]
    statuses = spark.createDataFrame([("a", True, "2025-01-02"), ("b", False, None)], "source_id string, enabled boolean, at string")
    due = lambda df, at: search.refresh_due(df, F.lit(at).cast("timestamp")).first().due
    assert not due(statuses, "2025-01-01") and due(statuses, "2025-01-03") and due(statuses.withColumn("enabled", F.lit(True)), "2025-01-01") and due(statuses.withColumn("at", F.lit("soon")), "2025-01-01") and not due(statuses.filter("not enabled"), "2025-01-03")
    with pytest.raises(ValueError, match="unknown sources: zz"):
        search.selected_sources(statuses, ["A", "zz"])
    assert [r.source_id for r in search.selected_sources(statuses).collect()] == ["a"] and search.selected_sources(statuses, ["B"]).count() == 1
    assert search.requested_buckets(" all ", ("x",)) == () and search.requested_buckets("x, ,x", ("x",)) == ("x", "x")
    with pytest.raises(ValueError, match="unknown buckets: y"):
        search.requested_buckets("x,y", ("x",))


def test_upsert_takes_the_highest_order_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("a", 2, 7)], "k string, o int, v int")
    incremental.upsert_batch(f"{tmp_path}/t", ["k"], "o")(rows.repartition(3), 0)
    assert [r.v for r in incremental.current(spark, f"{tmp_path}/t", ["k"]).collect()] == [6]
    with pytest.raises(Exception, match="twice"):
        incremental.upsert_batch(f"{tmp_path}/u", ["k"])(rows, 0)

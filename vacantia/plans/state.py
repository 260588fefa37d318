"""Queries of state: run logs, statuses, polls, cursors, summaries, identities, the faceted search over evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import analysis as a
from vacantia.functions import text as t
from vacantia.operators import identity, records, search
from vacantia.operators.search import SearchParams
from vacantia.plans.register import Register
from vacantia.plans.texts import _ANALYSIS, _FOLD, _has, _normal
from vacantia.streaming import incremental
from vacantia.tables import read, spread

query = Register()


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    """The latest event of each user, upserted batch by batch from a stream; of one time the highest id counts."""
    path = f"{d}/events.parquet"
    rows = incremental.upserted(spark, path, ["user_id"], "event_id") if _in_order(spark, path) else records.first_wins(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.select("user_id", "event_id", "event_type")


def _in_order(spark, path: str) -> bool:
    """Whether ids follow times, so that the highest id of a user is the latest event."""
    from pyspark.sql import Window

    near = spark.read.parquet(path).select("user_id", "event_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"))
    return near.filter("ts < before").isEmpty()


@query("""
WITH e AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS size, event_type = 'view' AS first_poll FROM events)
SELECT min(event_id) AS event_id, user_id, size FROM e GROUP BY user_id, size HAVING NOT bool_or(first_poll)""")
def primed_poll(spark, d):
    """What a second poll emits: the first one, of views, primes without emitting anything."""
    key = ["user_id", "size"]
    events = read(spark, d, "events").select("event_id", "user_id", F.floor("value").alias("size"), "event_type")
    first, seen = incremental.emitted(None, events.filter("event_type = 'view'"), key)
    out, _ = incremental.emitted(seen, records.first_wins(events.filter("event_type <> 'view'"), key, ["event_id"]), key)
    return first.unionByName(out).select("event_id", *key)


@query("SELECT event_id, user_id, TRUE AS safe_limit_reached FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 1000")
def next_messages(spark, d):
    """What a run after cursor 100 reads, in ascending order: at most five times its limit, which is the feature."""
    return incremental.next_messages(read(spark, d, "events").select("event_id", "user_id"), "event_id", 100, 200)


@query("SELECT event_id, user_id, FALSE AS safe_limit_reached FROM events ORDER BY event_id DESC LIMIT 200")
def first_messages(spark, d):
    return incremental.next_messages(read(spark, d, "events").select("event_id", "user_id"), "event_id", None, 200)


@query("SELECT j.id FROM jobs j LEFT JOIN (SELECT job_id, max(fetched_at) AS done FROM job_details GROUP BY job_id) d ON d.job_id = j.id WHERE d.done IS NULL OR j.last_seen_at > d.done")
def pending_work(spark, d):
    """Jobs without fetched page, or seen again since: what a poll finds to do."""
    done = read(spark, d, "job_details").select(F.col("job_id").alias("id"), "fetched_at")
    return records.pending(read(spark, d, "jobs"), done, "id", "last_seen_at", "fetched_at").select("id")


@query("SELECT source_group, greatest(0, epoch(max(created_at)) + 3600 - epoch(TIMESTAMP '2025-06-01 00:00:00')) AS seconds_left FROM job_postings GROUP BY source_group")
def cooldown_claims(spark, d):
    """Seconds until each group may be collected again."""
    epoch = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) / 1000000D")
    last = read(spark, d, "job_postings").groupBy("source_group").agg(F.max("created_at").alias("last"))
    return last.select("source_group", records.cooldown_left(epoch("last"), 3600, epoch("timestamp_ntz '2025-06-01 00:00:00'")).alias("seconds_left"))


@query("""
WITH n AS (SELECT job_id, raw_text, row_number() OVER (PARTITION BY job_id ORDER BY length(raw_text) DESC, id) AS k FROM job_postings WHERE raw_text IS NOT NULL),
w AS (SELECT n.job_id, n.raw_text FROM n LEFT JOIN job_details d ON d.job_id = n.job_id WHERE k = 1 AND (d.job_id IS NULL OR d.fetch_status = 'source_automation_prohibited' AND length(coalesce(d.description_text, '')) < length(n.raw_text)))
SELECT job_id, 'source_automation_prohibited' AS fetch_status, raw_text AS description_text FROM w UNION ALL SELECT job_id, fetch_status, description_text FROM job_details WHERE job_id NOT IN (SELECT job_id FROM w)""")
def summary_upsert(spark, d):
    """The longest text of each job's postings as summary where no page was fetched, or fetching is prohibited and it is longer."""
    summaries = records.longest(read(spark, d, "job_postings"), "job_id", "raw_text", "id").select("job_id", F.lit("source_automation_prohibited").alias("fetch_status"), F.col("raw_text").alias("description_text"))
    stored = read(spark, d, "job_details").select("job_id", "fetch_status", "description_text")
    return records.guarded(stored, summaries, "job_id", "fetch_status", "description_text", "source_automation_prohibited")


def _runs(spark, d) -> DataFrame:
    """Runs as the postings tell: one a group, which fails where it gave no confident posting."""
    rows = read(spark, d, "job_postings").groupBy("source", "source_group").agg(F.min("id").alias("run_id"), F.min("created_at").alias("started_at"), F.max("created_at").alias("last"), F.count("*").alias("postings_seen"), F.count_if(F.col("parse_confidence") >= 0.5).alias("postings_relevant"), F.count_distinct("job_id").alias("new_jobs"), F.count("source_message_url").alias("new_postings"))
    ended = F.when(F.col("postings_seen") > 1, F.col("last"))
    good = F.col("postings_relevant") > 0
    return rows.select("run_id", F.col("source").alias("source_id"), "started_at", ended.alias("finished_at"), F.when(good, "success").otherwise("error").alias("status"), *records.COUNTERS, F.when(~good, F.expr("repeat('no confident posting; ', 100)")).alias("error"))


_RUNS = """
g AS (SELECT source AS source_id, source_group, min(id) AS run_id, min(created_at) AS started_at, max(created_at) AS last, count(*) AS postings_seen, count(*) FILTER (parse_confidence >= 0.5) AS postings_relevant, count(DISTINCT job_id) AS new_jobs, count(source_message_url) AS new_postings FROM job_postings GROUP BY ALL),
s AS (SELECT run_id, source_id, started_at, CASE WHEN done THEN last ELSE started_at END AS at, CASE WHEN NOT done THEN 'running' WHEN good THEN 'success' ELSE 'error' END AS status, CASE WHEN done THEN postings_seen ELSE 0 END AS postings_seen, CASE WHEN done THEN postings_relevant ELSE 0 END AS postings_relevant, CASE WHEN done THEN new_jobs ELSE 0 END AS new_jobs, CASE WHEN done THEN new_postings ELSE 0 END AS new_postings, CASE WHEN done AND NOT good THEN substring(repeat('no confident posting; ', 100), 1, 2000) END AS error
FROM (SELECT *, postings_seen > 1 AS done, postings_relevant > 0 AS good FROM g))"""


@query(f"WITH {_RUNS} SELECT * FROM s")
def run_log(spark, d):
    """The last state of each run of an appended log; errors are cut at 2,000 characters."""
    return records.run_states(records.run_events(_runs(spark, d)))


def _statuses(spark, d) -> DataFrame:
    registry = read(spark, d, "source_groups").select(F.col("source").alias("source_id"), F.concat(F.upper(F.substring("source", 1, 1)), F.expr("substring(source, 2)")).alias("company"), F.lit("feed").alias("adapter"), (F.length("source") % 2 == 0).alias("enabled")).distinct()
    return search.latest_runs(records.run_states(records.run_events(_runs(spark, d))), registry, "at", "new_jobs")


@query(f"""
WITH {_RUNS}, r AS (SELECT DISTINCT source AS source_id, upper(substring(source, 1, 1)) || substring(source, 2) AS company, 'feed' AS adapter, length(source) % 2 = 0 AS enabled FROM source_groups)
SELECT r.*, coalesce(l.status, 'not_run') AS status, l.run_id, l.at, l.new_jobs FROM r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_id) ORDER BY run_id DESC) AS n FROM s) WHERE n = 1) l ON lower(l.source_id) = lower(r.source_id)""")
def source_statuses(spark, d):
    """Every source with its latest run, by company and adapter."""
    return search.by_company(_statuses(spark, d))


@query(f"""
WITH {_RUNS}, r AS (SELECT DISTINCT source AS source_id FROM source_groups WHERE length(source) % 2 = 0), l AS (SELECT lower(source_id) AS k, arg_max(s.at, run_id) AS last_at FROM s GROUP BY 1)
SELECT coalesce(bool_or(l.last_at IS NULL OR l.last_at <= TIMESTAMP '2025-12-01'), FALSE) AS due FROM r LEFT JOIN l ON l.k = lower(r.source_id)""")
def refresh_due(spark, d):
    return search.refresh_due(_statuses(spark, d), F.lit("2025-12-01").cast("timestamp"))


@query("SELECT DISTINCT source AS source_id FROM source_groups WHERE lower(source) IN ('lever', 'telegram')")
def selected_sources(spark, d):
    registry = read(spark, d, "source_groups").select(F.col("source").alias("source_id"), F.lit(True).alias("enabled")).distinct()
    return search.selected_sources(registry, ["Lever", "telegram"]).select("source_id")


@query(f"SELECT id AS job_id, sha256('url:' || lower({_normal('job_url')})) AS identity_key, 'url' AS kind FROM jobs WHERE job_url IS NOT NULL UNION ALL SELECT id, sha256('position:' || t || '|' || c || '|' || p), 'position' FROM (SELECT id, {_FOLD.format('title')} AS t, {_FOLD.format('company')} AS c, {_FOLD.format('location')} AS p FROM jobs) WHERE t <> '' AND c <> '' AND p <> ''")
def job_identities(spark, d):
    """The keys by which jobs are found again."""
    return identity.identities(read(spark, d, "jobs"))


@query(f"""
WITH k AS (SELECT lower({_normal('job_url')}) AS u, min(id) AS job_id FROM jobs WHERE job_url IS NOT NULL GROUP BY 1)
SELECT n.source_group, n.source_message_id, k.job_id FROM (SELECT DISTINCT source_group, source_message_id, job_url FROM normalized_jobs WHERE job_url IS NOT NULL) n JOIN k ON k.u = lower({_normal('n.job_url')})""")
def known_addresses(spark, d):
    """The jobs that parsed postings are by their address."""
    rows = read(spark, d, "normalized_jobs").filter("job_url is not null").select("source_group", "source_message_id", "job_url").distinct()
    return identity.by_address(rows, identity.identities(read(spark, d, "jobs"))).select("source_group", "source_message_id", "job_id")


@query(f"""
WITH j AS (SELECT id, {_FOLD.format('title')} || '|' || {_FOLD.format('company')} || '|' || {_FOLD.format('location')} AS k, try_cast(CASE WHEN regexp_matches(posted_on, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substring(posted_on, 1, 10) END AS DATE) AS day FROM jobs WHERE {_FOLD.format('title')} <> '' AND {_FOLD.format('company')} <> '' AND {_FOLD.format('location')} <> ''),
n AS (SELECT DISTINCT source_group, source_message_id, {_FOLD.format('title')} || '|' || {_FOLD.format('company')} || '|' || {_FOLD.format('location')} AS k, try_cast(CASE WHEN regexp_matches(posted_on, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substring(posted_on, 1, 10) END AS DATE) AS day FROM normalized_jobs WHERE {_FOLD.format('title')} <> '' AND {_FOLD.format('company')} <> '' AND {_FOLD.format('location')} <> '')
SELECT n.source_group, n.source_message_id, min(j.id) AS job_id FROM n JOIN j ON j.k = n.k AND abs(date_diff('day', n.day, j.day)) <= 21 GROUP BY ALL""")
def known_positions(spark, d):
    """The first job of the same position at most 21 days apart from a parsed posting."""
    rows = read(spark, d, "normalized_jobs").select("source_group", "source_message_id", "title", "company", "location", "posted_on").distinct()
    found = identity.by_position(rows, read(spark, d, "jobs"), ["source_group", "source_message_id"])
    return found.select("source_group", "source_message_id", "job_id")


_TECH = {n: a.TECHNOLOGIES[n] for n in ("Java", "Kafka", "Rust")}
_EVALUATED = f"""
e AS (SELECT job_id, CAST(round(max(parse_confidence) * 100) AS INT) AS match_score FROM job_postings GROUP BY job_id),
r AS (SELECT jobs.id, jobs.title, jobs.company, jobs.location, jobs.first_seen_at, match_score, CASE WHEN match_score >= 90 THEN 'high_match' WHEN match_score >= 70 THEN 'review' ELSE 'low_match' END AS match_bucket, CASE fetch_status WHEN 'blocked' THEN 'applied' WHEN 'http_error' THEN 'interested' END AS user_status, description_text, {_ANALYSIS.format('description_text')} AS x FROM jobs JOIN e ON e.job_id = jobs.id LEFT JOIN job_details d ON d.job_id = jobs.id)"""


def _evaluated(spark, d) -> DataFrame:
    """Jobs with an evaluation made from their postings, their page, technologies and status."""
    score = read(spark, d, "job_postings").groupBy(F.col("job_id").alias("id")).agg(F.round(F.max("parse_confidence") * 100).cast("int").alias("match_score"))
    pages = read(spark, d, "job_details").select(F.col("job_id").alias("id"), "description_text", "fetch_status")
    rows = spread(read(spark, d, "jobs"), "id").join(score, "id").join(pages, "id", "left")
    bucket = F.when(F.col("match_score") >= 90, "high_match").when(F.col("match_score") >= 70, "review").otherwise("low_match")
    status = F.when(F.col("fetch_status") == "blocked", "applied").when(F.col("fetch_status") == "http_error", "interested")
    return rows.withColumns({"match_bucket": bucket, "user_status": status, "technologies": t.alias_groups(t.analysis_text(F.col("description_text")), _TECH)})


def _page(spark, d, p: SearchParams) -> DataFrame:
    return search.page(_evaluated(spark, d), read(spark, d, "job_postings"), p).select("id", "match_score", "match_bucket", "description_text", "posting_count", "sources")


def _page_sql(where: str, order: str) -> str:
    return f"""
WITH {_EVALUATED}, top AS (SELECT * FROM r WHERE {where} ORDER BY {order} LIMIT 200)
SELECT top.id, match_score, match_bucket, substring(description_text, 1, 1500) AS description_text, count(p.id) AS posting_count, string_agg(DISTINCT p.source, ',' ORDER BY p.source) AS sources FROM top LEFT JOIN job_postings p ON p.job_id = top.id GROUP BY ALL"""


@query(_page_sql(f"match_bucket IN ('high_match', 'review') AND match_score >= 75 AND (lower(coalesce(title, '')) LIKE '%harbor%' OR lower(coalesce(company, '')) LIKE '%harbor%' OR lower(coalesce(location, '')) LIKE '%harbor%' OR lower(coalesce(description_text, '')) LIKE '%harbor%') AND user_status IS NULL", "match_score DESC, first_seen_at DESC, id DESC"))
def faceted_search(spark, d):
    """Free text over four columns, buckets, least score and status, by score; the start of the description as a preview."""
    buckets = search.requested_buckets("high_match, review", ("high_match", "review", "low_match", "rejected"))
    return _page(spark, d, SearchParams(text=" Harbor ", buckets=buckets, least_score=75, statuses=("none",), sort="score", snippet=1500))


@query(_page_sql(f"{_has('x', _TECH['Kafka'])} AND EXISTS (SELECT 1 FROM job_postings p WHERE p.job_id = r.id AND lower(p.source) = 'telegram')", "first_seen_at DESC, id DESC"))
def technology_search(spark, d):
    """Jobs that name a technology and come from a source, the newest first."""
    return _page(spark, d, SearchParams(technology="kafka", sources=search.normalised_sources(["Telegram ", "all"]), snippet=1500))


@query(f"WITH {_EVALUATED} SELECT count(*) FILTER (match_bucket = 'high_match') AS high_match, count(*) FILTER (match_bucket = 'review') AS review, count(*) FILTER (match_bucket = 'low_match') AS low_match, count(*) FILTER (match_bucket = 'rejected') AS rejected FROM r")
def bucket_summary(spark, d):
    return search.summary(_evaluated(spark, d), "match_bucket", ["high_match", "review", "low_match", "rejected"])


@query("SELECT id, title, company, job_url FROM jobs")
def dumped_jobs(spark, d):
    """All jobs written as JSON and read back."""
    import uuid

    from vacantia.tables import checkpoint_dir

    out = f"{checkpoint_dir(spark)}/dump-{uuid.uuid4().hex}"
    rows = read(spark, d, "jobs").select("id", "title", "company", "job_url")
    rows.write.json(out)
    return spark.read.schema(rows.schema).json(out)


QUERIES, ORACLE = query.queries, query.oracle

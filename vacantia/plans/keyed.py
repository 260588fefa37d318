"""Queries of keyed records: windows, first and latest wins, assembly, upserts, identity, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.operators import identity, records, timestamps
from vacantia.plans.register import Register
from vacantia.tables import cut_lineage, read

query = Register()


def _lines(spark, d):
    """(id, i, line) of the posting texts."""
    return read(spark, d, "job_postings").filter("raw_text is not null").select("id", F.posexplode(F.split("raw_text", "\n")).alias("i", "line"))


_LINES = "l AS (SELECT id, i - 1 AS i, string_split(raw_text, chr(10))[i] AS line FROM (SELECT id, raw_text, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) AS i FROM job_postings WHERE raw_text IS NOT NULL))"


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event_per_user(spark, d):
    return records.first_wins(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("SELECT source_group, source_message_id, min(title) AS title, count(*) AS copies FROM normalized_jobs GROUP BY ALL")
def repeated_messages(spark, d):
    return read(spark, d, "normalized_jobs").groupBy("source_group", "source_message_id").agg(F.min("title").alias("title"), F.count("*").alias("copies"))


@query("SELECT id, source_group, source_message_id FROM (SELECT *, row_number() OVER (PARTITION BY source, source_group, source_message_id ORDER BY id) AS n FROM job_postings) WHERE n = 1")
def dedupe_first_wins(spark, d):
    return records.first_wins(read(spark, d, "job_postings"), ["source", "source_group", "source_message_id"], ["id"]).select("id", "source_group", "source_message_id")


@query("""
SELECT source_group, source_message_id, row_number() OVER (PARTITION BY source_group, coalesce(sender, ''), coalesce(raw_text, '') ORDER BY source_message_id, message_date) AS occurrence
FROM (SELECT DISTINCT source_group, source_message_id, sender, raw_text, message_date FROM source_messages)""")
def occurrence_number(spark, d):
    rows = read(spark, d, "source_messages").select("source_group", "source_message_id", "sender", "raw_text", "message_date").distinct()
    rows = rows.withColumns({"s": F.coalesce("sender", F.lit("")), "r": F.coalesce("raw_text", F.lit(""))})
    return records.numbered(rows, ["source_group", "s", "r"], ["source_message_id", "message_date"]).select("source_group", "source_message_id", F.col("occurrence").cast("bigint").alias("occurrence"))


@query(f"""
WITH {_LINES}, h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(\\*|\\[|Location:|Details:|Apply:)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS record_no FROM l)
SELECT id, CAST(record_no AS BIGINT) AS record_no, string_agg(line, chr(10) ORDER BY i) AS body FROM h WHERE record_no > 0 GROUP BY ALL""")
def record_assembly(spark, d):
    return records.assembled(_lines(spark, d), ["id"], "i", "line", F.col("line").rlike(r"^(\*|\[|Location:|Details:|Apply:)"))


@query(f"""
WITH {_LINES} SELECT id, i, line, last_value(CASE WHEN contains(line, ':') THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before,
first_value(CASE WHEN contains(line, 'https') THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS after FROM l""")
def nearest_lines(spark, d):
    before = F.when(F.col("line").contains(":"), F.col("line"))
    after = F.when(F.col("line").contains("https"), F.col("line"))
    return _lines(spark, d).select("id", "i", "line", records.nearest_before(["id"], "i", before, 12).alias("before"), records.nearest_after(["id"], "i", after, 7).alias("after"))


@query(f"""
WITH {_LINES}, s AS (SELECT * FROM l WHERE trim(line) <> ''), k AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY i) AS before FROM s)
SELECT id, string_agg(line, chr(10) ORDER BY i) AS kept FROM k WHERE before IS DISTINCT FROM line GROUP BY id""")
def distinct_neighbours(spark, d):
    rows = read(spark, d, "job_postings").filter("raw_text is not null").select("id", t.distinct_neighbours(F.split("raw_text", "\n")).alias("lines"))
    return rows.filter(F.size("lines") > 0).select("id", F.array_join("lines", "\n").alias("kept"))


@query("""
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(CASE WHEN value >= 10 THEN value END, CASE WHEN value >= 10 THEN event_id END) AS last_large FROM events GROUP BY user_id""")
def coalesce_latest(spark, d):
    rows = read(spark, d, "events").withColumn("last_large", F.when(F.col("value") >= 10, F.col("value")))
    return records.latest_non_null(rows, ["user_id"], F.col("event_id"), ["event_type", "last_large"])


@query("""
WITH n AS (SELECT p.job_id AS id, n.title, row_number() OVER (PARTITION BY p.job_id ORDER BY p.id DESC, n.title DESC) AS r FROM normalized_jobs n JOIN job_postings p ON p.source_group = n.source_group AND p.source_message_id = n.source_message_id WHERE n.title IS NOT NULL)
SELECT j.id, coalesce(n.title, j.title) AS title FROM jobs j FULL JOIN (SELECT id, title FROM n WHERE r = 1) n ON n.id = j.id""")
def upsert_merge(spark, d):
    keys = read(spark, d, "job_postings").select(F.col("id").alias("posting_id"), F.col("job_id").alias("id"), "source_group", "source_message_id")
    typed = read(spark, d, "normalized_jobs").filter("title is not null").select("source_group", "source_message_id", "title").join(keys, ["source_group", "source_message_id"])
    latest = records.latest_non_null(typed, ["id"], F.struct("posting_id", "title"), ["title"])
    return records.upsert(read(spark, d, "jobs").select("id", "title"), latest, ["id"])


@query("SELECT DISTINCT source_group, source_message_id FROM source_messages m WHERE NOT EXISTS (SELECT 1 FROM job_postings p WHERE p.source_group = m.source_group AND p.source_message_id = m.source_message_id)")
def insert_missing(spark, d):
    key = ["source_group", "source_message_id"]
    return records.insert_missing(read(spark, d, "job_postings"), read(spark, d, "source_messages").select(*key), key)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def tombstones(spark, d):
    return records.with_tombstones(read(spark, d, "events"), ["user_id"], [F.desc("event_id")], F.col("event_type") == "error").select("user_id", "event_id", "value")


@query("SELECT id, job_id FROM job_postings WHERE job_id IN (SELECT job_id FROM job_details WHERE fetch_status = 'success')")
def cascade_delete(spark, d):
    live = read(spark, d, "job_details").filter("fetch_status = 'success'").select("job_id")
    return records.cascade(read(spark, d, "job_postings"), live, "job_id", "job_id").select("id", "job_id")


@query("SELECT j.id, CASE WHEN trim(coalesce(j.location, '')) = '' THEN d.final_url ELSE j.location END AS location FROM jobs j JOIN job_details d ON d.job_id = j.id")
def fill_blank(spark, d):
    rows = read(spark, d, "jobs").join(read(spark, d, "job_details").withColumnRenamed("job_id", "id"), "id")
    return rows.select("id", records.fill_blank(F.col("location"), F.col("final_url")).alias("location"))


@query("""
SELECT job_id, coalesce(arg_max(source_message_url, CASE WHEN coalesce(source_message_url, '') <> '' AND lower(trim(source)) IN ('ashby', 'greenhouse', 'lever', 'smartrecruiters', 'workable') THEN id END), arg_min(source_message_url, CASE WHEN coalesce(source_message_url, '') <> '' THEN id END)) AS preferred_url
FROM job_postings GROUP BY job_id""")
def preferred_url(spark, d):
    return records.preferred_url(read(spark, d, "job_postings"), "job_id", "source_message_url", "source", "id")


@query("SELECT source_group, greatest(0, max(id)) AS cursor FROM (SELECT source_group, 0 AS id FROM source_groups UNION ALL SELECT source_group, CAST(source_message_id AS BIGINT) FROM source_messages WHERE regexp_full_match(source_message_id, '[0-9]{1,12}')) GROUP BY source_group")
def group_cursors(spark, d):
    from vacantia.streaming import incremental

    state = read(spark, d, "source_groups").select("source_group", F.lit(0).cast("bigint").alias("cursor")).distinct()
    batch = read(spark, d, "source_messages").filter(F.col("source_message_id").rlike(r"^\d{1,12}$")).select("source_group", F.col("source_message_id").cast("bigint").alias("id"))
    return incremental.advance_cursor(state, batch, "source_group", "id")


@query("""
WITH k AS (SELECT DISTINCT source, source_group, source_message_id FROM job_postings)
SELECT count(*) AS checked, count(title) AS parsed, count(*) FILTER (k.source IS NULL) AS new_postings, count(*) FILTER (k.source IS NOT NULL) AS existing_postings FROM normalized_jobs n LEFT JOIN k ON k.source = n.source AND k.source_group = n.source_group AND k.source_message_id = n.source_message_id""")
def import_summary(spark, d):
    return records.import_summary(read(spark, d, "normalized_jobs"), read(spark, d, "job_postings"), ["source", "source_group", "source_message_id"])


_DAY = "try_cast(CASE WHEN regexp_matches(posted_on, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN substring(posted_on, 1, 10) END AS DATE)"


@query(f"""
WITH j AS (SELECT id, lower(title) AS t, lower(company) AS c, {_DAY} AS day FROM jobs WHERE title IS NOT NULL AND company IS NOT NULL AND {_DAY} IS NOT NULL)
SELECT a.id, min(b.id) AS earlier_id FROM j a JOIN j b ON a.t = b.t AND a.c = b.c AND b.id < a.id AND abs(date_diff('day', a.day, b.day)) <= 21 GROUP BY a.id""")
def position_band_match(spark, d):
    rows = read(spark, d, "jobs").filter("title is not null and company is not null").select("id", F.lower("title").alias("t"), F.lower("company").alias("c"), t.date_part(F.col("posted_on")).alias("day")).filter("day is not null")
    return rows.withColumn("earlier_id", records.first_within_days(rows, ["t", "c"], F.col("day"), "id", 21)).filter("earlier_id is not null").select("id", "earlier_id")


@query("SELECT count(*) AS events, CAST(count(DISTINCT event_id) AS BIGINT) AS ids, max(event_id) AS last_id FROM events WHERE event_id > 100")
def stream_cursor(spark, d):
    from vacantia.streaming import incremental

    rows = incremental.read_since(spark, f"{d}/events.parquet", "event_id", 100)
    return rows.agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.max("event_id").alias("last_id"))


@query("SELECT user_id, event_type, count(*) AS first_seen FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(spark, d):
    from vacantia.streaming import incremental

    rows = incremental.deduplicated(spark, f"{d}/events.parquet", ["user_id", "event_type"], "3650 days")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("first_seen"))


@query()
def resolved_jobs(spark, d):
    """Identity resolution of all parsed postings, in the order of the instants of their messages (unreadable ones last)."""
    rows = read(spark, d, "normalized_jobs")
    zones = read(spark, d, "source_groups").select("source_group", "tz_name", "date_order").dropDuplicates(["source_group"])
    timed = timestamps.with_parsed(rows.join(zones, "source_group", "left"), F.col("message_date"), "__day", "__at", F.col("tz_name"), F.col("date_order"))
    order = [F.coalesce("__at", F.lit(2**63 - 1)), F.coalesce("source_group", F.lit("")), F.coalesce("source_message_id", F.lit("")), F.xxhash64(*rows.columns)]
    timed = timed.withColumn("__o", F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order))))
    ranged = timed.repartitionByRange("__o").sortWithinPartitions("__o")
    postings = cut_lineage(ranged.select(*rows.columns, F.monotonically_increasing_id().alias("arrival_no")))
    return identity.resolved(postings)


@query("SELECT count(*) AS arrivals, count(DISTINCT (coalesce(source, ''), coalesce(source_group, ''), coalesce(source_message_id, ''))) AS new_postings FROM normalized_jobs")
def resolution_counts(spark, d):
    """Arrivals and, among them, postings that weren't there yet."""
    return resolved_jobs(spark, d).agg(F.count("*").alias("arrivals"), F.count_if("new_posting").alias("new_postings"))


QUERIES, ORACLE = query.queries, query.oracle

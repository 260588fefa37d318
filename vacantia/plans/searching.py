"""Queries of search: joins, facets, aggregates, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import search
from vacantia.operators.search import SearchParams
from vacantia.plans.register import Register
from vacantia.sources import feeds
from vacantia.tables import read

query = Register()


@query("""
SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus IN ('O', 'P') AND lower(c_name) LIKE '%1%' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 200""")
def top_orders_search(spark, d):
    wanted = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = read(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).join(wanted, "o_orderkey", "left_semi")
    customers = read(spark, d, "customer").filter(search.contains("c_name", "1")).withColumnRenamed("c_custkey", "o_custkey")
    rows = rows.join(customers, "o_custkey").join(read(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
    return rows.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(200).select("o_orderkey", "o_totalprice", "c_name", "n_name")


@query("""
SELECT o_orderkey, count(l_orderkey) AS items, coalesce(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus), '') AS statuses, min(l_linenumber) AS first_line
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def order_provenance(spark, d):
    per = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"), F.min("l_linenumber").alias("first_line"))
    return read(spark, d, "orders").select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("statuses", F.lit("")).alias("statuses"), "first_line")


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'X') AS x FROM orders")
def status_summary(spark, d):
    return search.summary(read(spark, d, "orders"), "o_orderstatus", ["O", "F", "P", "X"])


@query("""
SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def case_ranked_sort(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return read(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderpriority")


_SEARCH_WHERE = "(lower(coalesce(title, '')) LIKE '%engineer%' OR lower(coalesce(company, '')) LIKE '%engineer%' OR lower(coalesce(location, '')) LIKE '%engineer%') AND EXISTS (SELECT 1 FROM job_postings p WHERE p.job_id = jobs.id AND lower(p.source) IN ('telegram', 'lever'))"
_SEARCH = SearchParams(text="Engineer", sources=("telegram", "lever"))


@query(f"""
WITH top AS (SELECT id, title, company, first_seen_at FROM jobs WHERE {_SEARCH_WHERE} ORDER BY first_seen_at DESC, id DESC LIMIT 200)
SELECT top.id, title, company, count(p.id) AS posting_count, string_agg(DISTINCT p.source, ',' ORDER BY p.source) AS sources, arg_min_null(p.source_message_url, p.id) AS first_message_url
FROM top LEFT JOIN job_postings p ON p.job_id = top.id GROUP BY top.id, title, company""")
def job_search_page(spark, d):
    return search.page(read(spark, d, "jobs"), read(spark, d, "job_postings"), _SEARCH).select("id", "title", "company", "posting_count", "sources", "first_message_url")


@query(f"SELECT count(*) AS total FROM jobs WHERE {_SEARCH_WHERE}")
def job_search_total(spark, d):
    return search.total(read(spark, d, "jobs"), read(spark, d, "job_postings"), _SEARCH)


@query("SELECT id FROM jobs WHERE lower(coalesce(location, '')) LIKE '%port%' AND title LIKE '%Engineer'")
def location_filter(spark, d):
    jobs = read(spark, d, "jobs")
    return jobs.filter(search.contains("location", "Port") & F.col("title").endswith("Engineer")).select("id")


@query("SELECT job_id, count(*) AS posting_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, arg_min_null(source_message_url, id) AS first_message_url FROM job_postings GROUP BY job_id")
def job_provenance(spark, d):
    return search.provenance(read(spark, d, "job_postings"))


@query("SELECT id, coalesce(n, 0) AS postings FROM jobs LEFT JOIN (SELECT job_id, count(*) AS n FROM job_postings GROUP BY job_id) p ON p.job_id = id")
def posting_counts(spark, d):
    per = read(spark, d, "job_postings").groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n"))
    return read(spark, d, "jobs").select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("postings"))


@query("SELECT id FROM jobs WHERE NOT EXISTS (SELECT 1 FROM job_details WHERE job_id = id AND fetch_status = 'success')")
def pending_details(spark, d):
    done = read(spark, d, "job_details").filter("fetch_status = 'success'").select(F.col("job_id").alias("id"))
    return read(spark, d, "jobs").select("id").join(done, "id", "left_anti")


@query("""
SELECT id, posted_on FROM jobs WHERE NOT EXISTS (SELECT 1 FROM job_details WHERE job_id = id)
ORDER BY posted_on DESC NULLS LAST, id DESC LIMIT 50""")
def fetch_queue(spark, d):
    return read(spark, d, "jobs").join(read(spark, d, "job_details").select(F.col("job_id").alias("id")), "id", "left_anti").orderBy(F.desc("posted_on"), F.desc("id")).limit(50).select("id", "posted_on")


@query("SELECT fetch_status, count(*) AS pages FROM job_details GROUP BY fetch_status")
def status_counts(spark, d):
    return read(spark, d, "job_details").groupBy("fetch_status").agg(F.count("*").alias("pages"))


# The table doesn't keep the kind of content: a page without text and extractor stands for one that isn't markup.
@query("""
SELECT job_id, CASE WHEN fetch_status = 'source_automation_prohibited' THEN 'source_automation_prohibited' WHEN fetch_error LIKE '%resol%' THEN 'source_resolution_error' WHEN NOT regexp_matches(coalesce(final_url, ''), '^https?://') AND http_status IS NULL AND final_url IS NOT NULL THEN 'unsafe_url'
WHEN http_status IS NULL THEN 'request_error' WHEN http_status IN (401, 403, 429) THEN 'blocked' WHEN http_status >= 400 THEN 'http_error' WHEN extractor IS NULL AND description_text IS NULL AND fetch_status <> 'insufficient_content' THEN 'unsupported_content'
WHEN length(coalesce(description_text, '')) < 200 THEN 'insufficient_content' ELSE 'success' END AS outcome FROM job_details""")
def fetch_classification(spark, d):
    from vacantia.functions.text import is_public_url
    from vacantia.sources.pages import fetch_outcome

    c = F.col
    kind = F.when(c("extractor").isNull() & c("description_text").isNull() & (c("fetch_status") != "insufficient_content"), "application/pdf").otherwise("text/html")
    safe = is_public_url(c("final_url")) | c("final_url").isNull() | c("http_status").isNotNull()
    outcome = fetch_outcome(c("http_status"), F.length("description_text"), kind, c("fetch_status") == "source_automation_prohibited", ~F.coalesce(c("fetch_error").contains("resol"), F.lit(False)), safe)
    return read(spark, d, "job_details").select("job_id", outcome.alias("outcome"))


@query("""
SELECT event_id FROM events WHERE (0 = 0 OR value IS NULL) AND (CAST('click' AS VARCHAR) IS NULL OR event_type = 'click') AND value >= 10""")
def optional_predicates(spark, d):
    wanted, only_null = "click", False
    rows = read(spark, d, "events").filter("value >= 10")
    rows = rows.filter(F.col("event_type") == wanted) if wanted is not None else rows
    rows = rows.filter("value is null") if only_null else rows
    return rows.select("event_id")


@query("SELECT DISTINCT source AS value FROM job_postings WHERE trim(coalesce(source, '')) <> ''")
def source_options(spark, d):
    return search.options(read(spark, d, "job_postings"), "source")


@query("""
SELECT place, label, jobs FROM (SELECT regexp_replace(lower(label), '\\s+', ' ', 'g') AS place, min(label) AS label, CAST(sum(n) AS BIGINT) AS jobs
FROM (SELECT trim(location) AS label, count(*) AS n FROM jobs WHERE trim(coalesce(location, '')) <> '' GROUP BY 1) GROUP BY 1) ORDER BY jobs DESC, place LIMIT 200""")
def location_catalogue(spark, d):
    return search.location_catalogue(read(spark, d, "jobs"))


@query("SELECT n_name AS place, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY 2 DESC, 1 LIMIT 10")
def top_nations(spark, d):
    per = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return per.join(read(spark, d, "nation"), "n_nationkey").groupBy(F.col("n_name").alias("place")).agg(F.sum("customers").alias("customers")).orderBy(F.desc("customers"), "place").limit(10)


@query("SELECT source, id, message_date FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS n FROM job_postings) WHERE n <= 5")
def newest_per_source(spark, d):
    from vacantia.operators.records import top_per_key

    return top_per_key(read(spark, d, "job_postings"), ["source"], [F.desc("id")], 5).select("source", "id", "message_date")


@query("""
SELECT s.source, coalesce(t.status, 'not_run') AS status, t.run_id FROM (SELECT DISTINCT source FROM source_groups) s LEFT JOIN
(SELECT lower(source) AS key, arg_max(source_group, id) AS status, max(id) AS run_id FROM job_postings GROUP BY 1) t ON t.key = lower(s.source)""")
def latest_runs(spark, d):
    # The postings stand for a run log here, and their groups for its statuses.
    runs = read(spark, d, "job_postings").select(F.col("source").alias("source_id"), F.col("source_group").alias("status"), F.col("id").alias("run_id"))
    registry = read(spark, d, "source_groups").select(F.col("source").alias("source_id")).distinct()
    return search.latest_runs(runs, registry).withColumnRenamed("source_id", "source")


@query("""
SELECT source_job_id, location_search_text FROM public_postings
WHERE list_has_any(coalesce(country_codes, []), ['XA', 'XB']) OR lower(coalesce(location_search_text, '')) LIKE '%pelagia%' OR lower(coalesce(location_search_text, '')) LIKE '%remote%'""")
def relevant_places(spark, d):
    return feeds.relevant(read(spark, d, "public_postings"), ["XA", "XB"], ["Pelagia", "remote"]).select("source_job_id", "location_search_text")


@query("SELECT code, count(*) AS postings FROM (SELECT unnest(country_codes) AS code FROM public_postings) GROUP BY code")
def country_facets(spark, d):
    return read(spark, d, "public_postings").select(F.explode("country_codes").alias("code")).groupBy("code").agg(F.count("*").alias("postings"))


@query("""
SELECT s AS source FROM (SELECT DISTINCT source AS s FROM job_postings EXCEPT SELECT source FROM source_trust WHERE trust_rank <= 3) t""")
def untrusted_sources(spark, d):
    return read(spark, d, "job_postings").select("source").subtract(read(spark, d, "source_trust").filter("trust_rank <= 3").select("source"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS seen, count(*) FILTER (parse_confidence >= 0.5) AS relevant, count(DISTINCT job_id) AS jobs FROM job_postings GROUP BY source")
def run_counters(spark, d):
    return read(spark, d, "job_postings").groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.col("parse_confidence") >= 0.5).alias("relevant"), F.count_distinct("job_id").alias("jobs"))


QUERIES, ORACLE = query.queries, query.oracle

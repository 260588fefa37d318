"""Queries of sources. The test tables hold parsed rows, so payloads are written from them first and then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import markup
from vacantia.functions import text as t
from vacantia.plans.register import Register
from vacantia.plans.texts import _normal
from vacantia.sources import feeds
from vacantia.tables import read

query = Register()


def _payloads(spark, d, item, root: str | None):
    rows = read(spark, d, "public_postings").dropDuplicates(["source_job_id"])
    body = F.to_json(F.array(item)) if root is None else F.to_json(F.struct(F.array(item).alias(root)))
    return rows.select("source_id", F.col("source_id").alias("company"), body.alias("payload"))


def _collapsed(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"


def _want(description: str, url: str = "job_url", place: str = "location") -> str:
    return f"""
SELECT DISTINCT source_job_id, {_collapsed('title')} AS title, nullif({_collapsed(place)}, '') AS location, strftime(try_cast(CASE WHEN regexp_matches(posted_on, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substring(posted_on, 1, 10) END AS DATE), '%Y-%m-%d') AS posted_on, {url} AS job_url, {description} AS description_text
FROM public_postings WHERE {_collapsed('title')} <> '' AND job_url IS NOT NULL AND trim(source_job_id) <> ''"""


_READ = ("source_job_id", "title", "location", "posted_on", "job_url", "description_text")


@query(_want(_collapsed("description_text"), _normal("job_url")))
def feed_greenhouse(spark, d):
    c = F.col
    item = F.struct(c("source_job_id").alias("id"), c("title"), c("job_url").alias("absolute_url"), F.struct(c("location").alias("name")).alias("location"), c("posted_on").alias("first_published"), c("description_text").alias("content"))
    return feeds.postings(_payloads(spark, d, item, "jobs"), "greenhouse").select(*_READ)


_BASE = f"SELECT DISTINCT source_job_id, {_collapsed('title')} AS title, nullif({_collapsed('location')}, '') AS location, {_normal('job_url')} AS job_url, {_collapsed('description_text')} AS description_text, length(coalesce(description_text, '')) AS n FROM public_postings WHERE {_collapsed('title')} <> '' AND job_url IS NOT NULL AND trim(source_job_id) <> ''"
_WIDE = (*_READ, "codes", "search")


def _wide(df):
    """With the countries and the text by which places are found."""
    return df.withColumns({"codes": F.array_join("country_codes", ","), "search": F.trim(F.regexp_replace("location_search_text", r"\s+", " "))}).select(*_WIDE)


@query(f"SELECT source_job_id, title, location, strftime(CAST(make_timestamp(CAST((1700000000 + n * 3600) AS BIGINT) * 1000000) AS DATE), '%Y-%m-%d') AS posted_on, job_url, description_text, 'DE' AS codes, trim(concat_ws(' ', location, 'Bonn Ulm')) AS search FROM ({_BASE})")
def feed_lever(spark, d):
    """A feed with times in milliseconds, a country and more places; texts are in either of two fields."""
    c = F.col
    n = F.length(F.coalesce("description_text", F.lit("")))
    html = F.when(n % 2 == 0, F.regexp_replace(F.regexp_replace(c("description_text"), "&", "&amp;"), "<", "&lt;"))
    places = F.struct(c("location"), F.array(F.lit("Bonn"), F.lit("Ulm")).alias("allLocations"))
    item = F.struct(c("source_job_id").alias("id"), c("title").alias("text"), c("job_url").alias("hostedUrl"), ((1_700_000_000 + n.cast("bigint") * 3600) * 1000).alias("createdAt"), F.lit("de").alias("country"), places.alias("categories"), F.when(n % 2 == 1, c("description_text")).otherwise("").alias("descriptionPlain"), F.concat(F.lit("<p>"), html, F.lit("</p>")).alias("description"))
    return _wide(feeds.postings(_payloads(spark, d, item, None), "lever"))


@query(f"SELECT source_job_id, title, location, strftime(DATE '2025-01-01' + CAST(n % 300 AS INT), '%Y-%m-%d') AS posted_on, job_url, description_text, 'IL' AS codes, trim(concat_ws(' ', location, 'Jaffa Israel Haifa')) AS search FROM ({_BASE}) WHERE n % 5 <> 0")
def feed_ashby(spark, d):
    """A feed with secondary places, an address, and postings that aren't listed."""
    c = F.col
    n = F.length(F.coalesce("description_text", F.lit("")))
    day = F.concat(F.date_add(F.lit("2025-01-01").cast("date"), n % 300).cast("string"), F.lit("T10:00:00Z"))
    address = F.struct(F.struct(F.lit("Israel").alias("addressCountry"), F.lit("Haifa").alias("addressLocality")).alias("postalAddress"))
    item = F.struct(c("source_job_id").alias("id"), c("title"), c("job_url").alias("jobUrl"), c("location"), day.alias("publishedAt"), (n % 5 != 0).alias("isListed"), F.array(F.struct(F.lit("Jaffa").alias("location"))).alias("secondaryLocations"), address.alias("address"), c("description_text").alias("descriptionPlain"))
    return _wide(feeds.postings(_payloads(spark, d, item, "jobs"), "ashby"))


@query(_want(_collapsed("title"), "'https://jobs.smartrecruiters.com/' || url_encode(source_id) || '/' || url_encode(source_job_id)"))
def feed_smartrecruiters(spark, d):
    c = F.col
    item = F.struct(c("source_job_id").alias("id"), F.when(c("job_url").isNotNull(), c("title")).alias("name"), F.struct(c("location").alias("fullLocation")).alias("location"), c("posted_on").alias("releasedDate"))
    return feeds.postings(_payloads(spark, d, item, "content"), "smartrecruiters").select(*_READ)


@query(f"SELECT source_job_id, title, concat_ws(', ', location, 'North', 'Israel') AS location, strftime(DATE '2025-01-01' + CAST(n % 300 AS INT), '%Y-%m-%d') AS posted_on, job_url, description_text, 'IL,XA' AS codes, concat_ws(', ', location, 'North', 'Israel') || ' Wien Austria xa Graz xa' AS search FROM ({_BASE})")
def feed_workable(spark, d):
    """A feed with codes of its places, of which equal ones count once, and a country without code."""
    c = F.col
    day = F.date_add(F.lit("2025-01-01").cast("date"), F.length(F.coalesce("description_text", F.lit(""))) % 300).cast("string")
    places = F.array(F.struct(F.lit("Wien").alias("city"), F.lit("Austria").alias("country_name"), F.lit("xa").alias("country_code")), F.struct(F.lit("Graz").alias("city"), F.lit(None).cast("string").alias("country_name"), F.lit("xa").alias("country_code")))
    item = F.struct(c("source_job_id").alias("shortcode"), c("title"), c("job_url").alias("shortlink"), c("location").alias("city"), F.lit("North").alias("state"), F.lit("Israel").alias("country"), places.alias("locations"), day.alias("created_at"), c("description_text").alias("description"))
    return _wide(feeds.postings(_payloads(spark, d, item, "jobs"), "workable"))


QUERIES, ORACLE = query.queries, query.oracle

"""Public job feeds: raw JSON payloads to postings, all in the JVM but for HTML fragments.

Each adapter is a table of paths into a VARIANT. An element that isn't an object, or lacks title, id or address, is
skipped by itself; a payload without its list of jobs raises, as the source of that payload has failed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import schemas
from vacantia.functions import text as t
from vacantia.functions.markup import plain_text


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("item"), f"$.{path}", kind)


def _text(path: str) -> Column:
    return plain_text(_get(path))


def _or(*columns: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _joined(between: str, *columns: Column) -> Column:
    return F.concat_ws(between, *(F.nullif(c, F.lit("")) for c in columns))


def _list(path: str) -> Column:
    return F.coalesce(_get(path, "array<variant>"), F.array().cast("array<variant>"))


def _each(path: str, *fields: str) -> Column:
    """The given fields of a list of objects, or its elements themselves, as one text."""
    def one(x: Column) -> Column:
        return F.concat_ws(" ", *(F.try_variant_get(x, f"$.{f}", "string") for f in fields)) if fields else F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))
    return F.array_join(F.transform(_list(path), one), " ")


def _codes(*columns: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.upper(F.nullif(c, F.lit(""))) for c in columns)))))


# Country names that two feeds give instead of a code.
COUNTRY_CODES = {"israel": "IL"}


def country_code(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, code in COUNTRY_CODES.items():
        out = F.when(F.lower(name) == n, code).otherwise(out)
    return out


def adapters() -> dict[str, tuple[str, dict[str, Column]]]:
    """For each feed the path of its list, and its columns."""
    empty = F.array().cast("array<string>")
    smart_place = _or(_text("location.fullLocation"), _joined(", ", _text("location.city"), _text("location.region"), _text("location.country")))
    workable_place = _joined(", ", _text("city"), _text("state"), _text("country"))
    entries = F.transform(_list("locations"), lambda x: F.upper(F.try_variant_get(x, "$.country_code", "string")))
    return {
        "greenhouse": ("$.jobs", {
            "id": _get("id"), "title": _text("title"), "url": _get("absolute_url"), "location": _text("location.name"), "posted": F.coalesce(t.date_part(_get("first_published")), t.date_part(_get("updated_at"))),
            "description": _text("content"), "codes": empty, "search": _text("location.name")}),
        "lever": ("$", {
            "id": _get("id"), "title": _text("text"), "url": _get("hostedUrl"), "location": _text("categories.location"), "posted": t.epoch_millis_date(_get("createdAt", "double")),
            "description": _or(_text("descriptionPlain"), _text("description")), "codes": _codes(_get("country")), "search": F.concat_ws(" ", _text("categories.location"), _each("categories.allLocations"))}),
        "ashby": ("$.jobs", {
            "id": _get("id"), "title": _text("title"), "url": _get("jobUrl"), "location": _text("location"), "posted": t.date_part(_get("publishedAt")), "description": _or(_text("descriptionPlain"), _text("descriptionHtml")),
            "codes": _codes(country_code(_text("address.postalAddress.addressCountry"))), "listed": F.coalesce(_get("isListed", "boolean"), F.lit(True)),
            "search": F.concat_ws(" ", _text("location"), _each("secondaryLocations", "location"), _text("address.postalAddress.addressCountry"), _text("address.postalAddress.addressLocality"))}),
        "smartrecruiters": ("$.content", {
            "id": _or(_get("id"), _get("uuid")), "title": _text("name"), "url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.url_encode(F.col("company")), F.lit("/"), F.url_encode(_or(_get("id"), _get("uuid")))),
            "location": smart_place, "posted": t.date_part(_get("releasedDate")), "description": _text("name"), "codes": _codes(_get("location.country")), "search": smart_place}),
        "workable": ("$.jobs", {
            "id": _or(_get("shortcode"), _get("code")), "title": _text("title"), "url": _or(_get("shortlink"), _get("url")), "location": workable_place, "posted": F.coalesce(t.date_part(_get("published_on")), t.date_part(_get("created_at"))),
            "description": _text("description"), "codes": F.array_sort(F.array_distinct(F.array_compact(F.concat(entries, F.array(country_code(_text("country"))))))),
            "search": F.concat_ws(" ", workable_place, _each("locations", "city", "state", "country_name", "country_code"))}),
    }


POSTING = ("source_id", "company", "source_job_id", "title", "location", "posted_on", "job_url", "description_text", "country_codes", "location_search_text")


def postings(payloads: DataFrame, adapter: str) -> DataFrame:
    """Postings of raw payloads (source_id, company, payload); a page of a paged feed is a payload of its own."""
    path, c = adapters()[adapter]
    root = F.parse_json("payload")
    kind = F.schema_of_variant(root if path == "$" else F.try_variant_get(root, path, "variant"))
    checked = F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.try_variant_get(root, path, "array<variant>")).otherwise(F.raise_error(F.lit(f"{adapter} feed has no list of jobs")))
    rows = payloads.select("source_id", "company", F.explode(checked).alias("item")).filter(F.schema_of_variant("item").startswith("OBJECT"))
    rows = rows.select(
        "source_id", "company", F.trim(c["id"]).alias("source_job_id"), c["title"].alias("title"), F.nullif(c["location"], F.lit("")).alias("location"), c["posted"].cast("string").alias("posted_on"),
        t.normalize_url(F.coalesce(c["url"], F.lit(""))).alias("job_url"), F.coalesce(c["description"], F.lit("")).alias("description_text"), c["codes"].alias("country_codes"), F.trim(c["search"]).alias("location_search_text"), c.get("listed", F.lit(True)).alias("listed"),
    )
    return rows.filter("listed and job_url <> '' and title <> '' and source_job_id <> ''").select(*POSTING)


def relevant(df: DataFrame, codes: list[str], terms: list[str]) -> DataFrame:
    """Postings in one of the countries, or whose place holds one of the terms; no conditions keep all."""
    if not codes and not terms:
        return df
    text = F.lower(F.coalesce("location_search_text", F.lit("")))
    hit = F.arrays_overlap(F.coalesce("country_codes", F.array().cast("array<string>")), F.array(*map(F.lit, codes or ["-"])))
    for term in terms:
        hit = hit | text.contains(term.lower())
    return df.filter(F.coalesce(hit, F.lit(False)))


def to_jobs(df: DataFrame, adapter: str) -> DataFrame:
    """Postings as normalised jobs."""
    c = F.col
    return schemas.jobs(df, source=F.lit(adapter), source_group=c("source_id"), source_message_id=c("source_job_id"), source_message_url=c("job_url"), message_date=c("posted_on"), title=c("title"), company=c("company"), location=c("location"), posted_on=c("posted_on"), job_url=c("job_url"), raw_text=F.concat_ws("\n", "title", "location", "description_text"), parse_confidence=F.lit(1.0))


def sitemap_urls(payloads: DataFrame, host: str | None = None, prefix: str = "/") -> DataFrame:
    """(source_id, job_url, n): the addresses of XML sitemaps that are on the host (of the column ``host``, if none is
    given) below the path, each once. A sitemap without any raises."""
    urls = F.expr("xpath(payload, '//*[local-name()=\"url\"]/*[local-name()=\"loc\"]/text()')")
    wanted = F.col("host") if host is None else F.lit(host)
    ok = F.filter(F.transform(urls, lambda u: t.expected_https_url(t.normalize_url(F.trim(u)), wanted, prefix)), lambda u: u.isNotNull())
    listed = payloads.select("source_id", F.array_distinct(ok).alias("urls"))
    some = F.when(F.size("urls") > 0, F.col("urls")).otherwise(F.raise_error(F.lit("a sitemap has no address of a job")))
    rows = listed.select("source_id", F.posexplode(some).alias("n", "job_url"))
    return rows.groupBy("source_id", "job_url").agg(F.min("n").alias("n"))


MOST_BYTES, MOST_PAGES, PAGE_ROWS = 12 * 1024 * 1024, 20, 100


def land(payloads: DataFrame, folder: str) -> None:
    """Leaves payloads (source_id, page, value) as a downloader does: one text file a page, below its source."""
    lined = payloads.withColumn("value", F.regexp_replace("value", r"[\r\n]+", " "))
    lined.repartition("source_id", "page").write.partitionBy("source_id", "page").text(folder, lineSep="\n")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, company, page_no, payload) of the pages that a downloader left below ``source_id=.../page=...``; the
    company is the source's identifier. A payload over the size limit raises, as does a source of too many pages."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    name = lambda k: F.regexp_extract("path", r"source_id=([^/]+)/page=(\d+)/[^/]*$", k)
    page = F.when(name(2).cast("int") < MOST_PAGES, name(2).cast("int")).otherwise(F.raise_error(F.lit(f"a feed has over {MOST_PAGES} pages")).cast("int"))
    text = F.when(F.col("length") <= MOST_BYTES, F.decode("content", "utf-8")).otherwise(F.raise_error(F.lit(f"a payload has over {MOST_BYTES} bytes")))
    # The folder's name is escaped once by the downloader and once by the file system.
    source = F.url_decode(F.url_decode(F.url_decode(name(1))))
    return raw.select(source.alias("source_id"), source.alias("company"), page.alias("page_no"), text.alias("payload"))


def page_requests(total: int, rows: int = PAGE_ROWS) -> list[int]:
    """The offsets at which the pages of a paged feed begin."""
    if -(-total // rows) > MOST_PAGES:
        raise ValueError(f"a feed has over {MOST_PAGES} pages")
    return list(range(0, total, rows))


def dispatched(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Postings of all payloads, each by the adapter of its source (source_id, adapter); other sources are left out."""
    known = payloads.join(sources.select("source_id", "adapter"), "source_id")
    parts = [postings(known.filter(F.col("adapter") == name), name).withColumn("adapter", F.lit(name)) for name in adapters()]
    return reduce(DataFrame.unionByName, parts)

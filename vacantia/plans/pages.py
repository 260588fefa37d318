"""Queries of pages, cards and e-mails: written from the test tables first and then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.plans.register import Register
from vacantia.plans.texts import _normal
from vacantia.sources import feeds, mail, pages
from vacantia.tables import read

query = Register()


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")


def _collapsed(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"


_PAGE_TEXT = """
l AS (SELECT job_id, i, trim(regexp_replace(string_split(replace(description_text, chr(160), ' '), chr(10))[i], '[ \\t]+', ' ', 'g')) AS line FROM (SELECT job_id, description_text, unnest(range(1, len(string_split(description_text, chr(10))) + 1)) AS i FROM job_details WHERE description_text IS NOT NULL)),
k AS (SELECT *, lag(line) OVER (PARTITION BY job_id ORDER BY i) AS before FROM l WHERE line <> ''),
p AS (SELECT job_id, substring(string_agg(line, chr(10) ORDER BY i), 1, 60000) AS text FROM k WHERE before IS DISTINCT FROM line GROUP BY job_id),
j AS (SELECT d.job_id, nullif({title}, '') AS title, nullif({company}, '') AS company, nullif({location}, '') AS location, coalesce(p.text, '') AS text, d.final_url FROM job_details d JOIN jobs ON jobs.id = d.job_id LEFT JOIN p ON p.job_id = d.job_id WHERE d.description_text IS NOT NULL)""".format(title=_collapsed("jobs.title"), company=_collapsed("jobs.company"), location=_collapsed("jobs.location"))


def _details(spark, d) -> DataFrame:
    jobs = read(spark, d, "jobs").select(F.col("id").alias("job_id"), "title", "company", "location", "posted_on")
    return read(spark, d, "job_details").filter("description_text is not null").select("job_id", "final_url", "page_title", "description_text").join(jobs, "job_id")


def _posting_json(description: Column) -> Column:
    """Structured data of a job, with a nested type list and an object as place."""
    c = F.col
    place = F.struct(F.lit("Place").alias("@type"), F.struct(c("location").alias("addressLocality")).alias("address"))
    posting = F.struct(F.array(F.lit("jobposting"), F.lit("Thing")).alias("@type"), F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit("")).alias("title"), F.struct(c("company").alias("name")).alias("hiringOrganization"), F.when(F.trim(F.coalesce("location", F.lit(""))) != "", F.array(place)).alias("jobLocation"), description.alias("description"))
    return F.regexp_replace(F.to_json(F.struct(F.array(posting).alias("@graph"))), "</", "<\\\\/")


_FIELDS = ("job_id", "page_title", "company", "location", "description_text", "extractor")


@query(f"""
WITH {_PAGE_TEXT} SELECT job_id, coalesce(title, 'Jobs') AS page_title, company, location, CASE WHEN length(text) >= 200 THEN text END AS description_text, CASE WHEN length(text) >= 200 THEN 'json-ld' ELSE 'html-fallback' END AS extractor FROM j""")
def structured_pages(spark, d):
    """Pages with structured data: an unreadable script before it doesn't matter, a short description falls back to the body."""
    html = F.concat(F.lit('<html><head><title> Jobs </title><script type="application/ld+json">{broken</script><script type="application/ld+json">'), _posting_json(_escaped(F.col("description_text"))), F.lit("</script></head><body>short</body></html>"))
    rows = _details(spark, d).select("job_id", "final_url", html.alias("html"))
    return pages.read_pages(rows).select(*_FIELDS)


@query(f"""
WITH {_PAGE_TEXT}, b AS (SELECT *, concat_ws(chr(10), 'Menu', title, location, CASE WHEN split_part(text, chr(10), 1) = coalesce(location, title) THEN nullif(substring(text, length(split_part(text, chr(10), 1)) + 2), '') ELSE nullif(text, '') END) AS body FROM j)
SELECT job_id, title AS page_title, 'Zorbel' AS company, location, CASE WHEN length(text) >= 200 THEN text WHEN length(body) >= 200 THEN body END AS description_text, 'html-fallback' AS extractor FROM b""")
def marked_pages(spark, d):
    """Pages without structured postings: title of the heading, company of the site's organisation, place and description of
    elements that are marked by part of a class."""
    organisation = F.concat(F.lit('<script type="application/ld+json">{"@type":"Organization","name":"Zorbel","url":"'), F.col("final_url"), F.lit('"}</script>'))
    lines = F.concat(F.lit("<p>"), F.regexp_replace(_escaped(F.col("description_text")), "\n", "</p><p>"), F.lit("</p>"))
    html = F.concat(F.lit("<html><body>"), organisation, F.lit("<nav>Menu</nav><h1>"), _escaped(F.coalesce("title", F.lit(""))), F.lit('</h1><span class="x-job-location-y">'), _escaped(F.coalesce("location", F.lit(""))), F.lit('</span><div class="the job-description-box">'), lines, F.lit("</div><script>var a</script></body></html>"))
    rows = _details(spark, d).select("job_id", "final_url", html.alias("html"))
    return pages.read_pages(rows).select(*_FIELDS)


@query(f"""
WITH {_PAGE_TEXT} SELECT job_id, title AS page_title, company, coalesce(location, 'Remote') AS location, CASE WHEN length(text) >= 200 THEN text END AS description_text, 'html-fallback' AS extractor FROM j""")
def plain_pages(spark, d):
    """Pages whose body is the description, with employer and kind of work in structured data; scripts go."""
    posting = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("title"), F.col("company").alias("hiringOrganization"), F.when(F.trim(F.coalesce("location", F.lit(""))) != "", F.array("location")).alias("jobLocation"), F.lit("TELECOMMUTE").alias("jobLocationType")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.regexp_replace(posting, "</", "<\\\\/"), F.lit("</script></head><body><script>x()</script>"), F.regexp_replace(_escaped(F.col("description_text")), "\n", "<br>"), F.lit("</body></html>"))
    rows = _details(spark, d).select("job_id", "final_url", html.alias("html"))
    return pages.read_pages(rows).select(*_FIELDS)


@query(f"SELECT job_id, nullif({_collapsed('page_title')}, '') AS page_title FROM job_details WHERE page_title IS NOT NULL AND description_text IS NOT NULL")
def html_title(spark, d):
    html = F.concat(F.lit("<html><head><title>"), _escaped(F.col("page_title")), F.lit("</title></head><body>"), _escaped(F.col("description_text")), F.lit("</body></html>"))
    rows = read(spark, d, "job_details").filter("page_title is not null and description_text is not null").select("job_id", "final_url", html.alias("html"))
    return pages.read_pages(rows).select("job_id", "page_title")


@query(f"""
SELECT id, CASE WHEN ok THEN 'j-' || id END AS source_job_id, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN location || ', Israel' END AS location, CASE WHEN ok THEN nullif(substring(posted_on, 1, 10), '') END AS posted_on, CASE WHEN ok THEN ['IL'] END AS country_codes, CASE WHEN NOT ok THEN 'incomplete posting data' END AS reason
FROM (SELECT id, {_collapsed('title')} AS title, coalesce(nullif({_collapsed('location')}, ''), 'Haifa') AS location, posted_on, {_collapsed('title')} <> '' AS ok FROM jobs)""")
def job_pages(spark, d):
    """The own pages of all jobs; those without a title can't be used."""
    c = F.col
    place = F.when(F.trim(F.coalesce("location", F.lit(""))) == "", "Haifa").otherwise(_escaped(c("location")))
    posting = F.struct(F.lit("JobPosting").alias("@type"), F.struct(F.concat(F.lit("j-"), c("id").cast("string")).alias("value")).alias("identifier"), _escaped(F.coalesce("title", F.lit(""))).alias("title"), c("posted_on").alias("datePosted"), F.struct(F.struct(place.alias("addressLocality"), F.lit("Israel").alias("addressCountry")).alias("address")).alias("jobLocation"), F.lit("text").alias("description"))
    html = F.concat(F.lit('<script type="application/ld+json">'), F.regexp_replace(F.to_json(posting), "</", "<\\\\/"), F.lit("</script>"))
    return pages.read_job_pages(read(spark, d, "jobs").select("id", html.alias("html"))).select("id", "source_job_id", "title", "location", "posted_on", "country_codes", "reason")


_KEPT = f"{_collapsed('title')} <> '' AND {_collapsed('location')} <> ''"


@query(f"SELECT DISTINCT CAST(id AS VARCHAR) AS job_id, {_collapsed('title')} AS title, {_collapsed('location')} AS location, nullif(substring({_collapsed('posted_on')}, 1, 10), '') AS posted_on, 'https://h.example/job/' || id AS job_url FROM jobs WHERE {_KEPT}")
def card_pages(spark, d):
    """Pages of cards, two of each job: the second counts for nothing, cards without title or place are skipped."""
    c = F.col
    card = F.concat(F.lit("<li class='card x'><h3 class=t>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</h3><p class=p>"), _escaped(F.coalesce("location", F.lit(""))), F.lit("</p><i class=d>"), _escaped(F.coalesce("posted_on", F.lit(""))), F.lit("</i><a class='btn' href='https://h.example/job/"), c("id").cast("string"), F.lit("/'>go</a></li>"))
    rows = read(spark, d, "jobs").select("id", F.concat(F.lit("<ul>"), card, F.when(F.trim(F.coalesce("location", F.lit(""))) != "", F.regexp_replace(card, "<p class=p>", "<p class=p>again ")).otherwise(""), F.lit("</ul>")).alias("payload"))
    parsed = mail.read_page_cards(rows, mail.page_cards("card", "t", "p", "d", "btn", "x", "h.example", r"/job/(\d+)/?"))
    cards = parsed.select(F.explode("cards").alias("c")).select("c.*")
    return cards.select("job_id", "title", "location", F.nullif("posted_on", F.lit("")).alias("posted_on"), "job_url").distinct()


def _eml(sender: str, subject: str, body: Column) -> Column:
    day = F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")
    return F.encode(F.concat(F.lit(f"From: {sender}\nSubject: {subject}\nDate: "), day, F.lit(" Jan 2025 10:00:00 +0200\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), body), "utf-8")


_DAY = "'2025-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00+02:00'"


@query(f"SELECT CAST(id AS VARCHAR) AS job_id, {_collapsed('title')} AS title, {_collapsed('company')} AS company, {_collapsed('location')} AS location, {_DAY} AS message_date, 'https://www.linkedin.com/jobs/view/' || id AS job_url FROM jobs WHERE {_KEPT} AND {_collapsed('company')} <> ''")
def network_mail(spark, d):
    """E-mails with a marked card each; cards without title, company or place are skipped."""
    c = F.col
    card = F.concat(F.lit("<table><tr><td><a class='x text-color-brand' href='https://www.linkedin.com/comm/jobs/view/"), c("id").cast("string"), F.lit("?trk=a'>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</a><p class='text-system-gray-100'>"), _escaped(F.coalesce("company", F.lit(""))), F.lit(" &middot; "), _escaped(F.coalesce("location", F.lit(""))), F.lit("</p></td></tr></table>"))
    rows = read(spark, d, "jobs").select("id", F.col("id").cast("string").alias("path"), _eml("Jobs <jobs-noreply@linkedin.com>", "New jobs", F.concat(card, card)).alias("content"))
    jobs = mail.to_jobs(mail.read_cards(rows, "network_mail"), "linkedin_email", "mail", 0.9)
    return jobs.select(F.col("source_message_id").alias("job_id"), "title", "company", "location", "message_date", "job_url")


_TITLED = f"length({_collapsed('title')}) >= 3 AND NOT starts_with(lower({_collapsed('title')}), 'posted ') AND NOT regexp_matches({_collapsed('title')}, '[<>@]|[0-9]{{4,}}')"
_PLACED = f"NOT regexp_matches({_collapsed('location')}, '[<>@]|[0-9]{{4,}}|^[-*•]') AND {_collapsed('location')} <> ''"


@query(f"SELECT CAST(10000000 + id AS VARCHAR) AS job_id, {_collapsed('title')} AS title, CASE WHEN id % 3 = 0 THEN 'Annapurna Labs Ltd.' WHEN id % 3 = 1 THEN 'Amazon Web Ltd.' ELSE 'Amazon' END AS company, {_collapsed("location || ', Israel'")} AS location, {_DAY} AS message_date, 'https://www.amazon.jobs/jobs/' || (10000000 + id) AS job_url FROM jobs WHERE {_TITLED} AND {_PLACED}")
def store_mail(spark, d):
    """E-mails of a store: links tracked and encoded twice, place and company on lines of the card."""
    c = F.col
    number = (c("id") + 10_000_000).cast("string")
    company = F.when(c("id") % 3 == 0, "<div>At Annapurna Labs</div>").when(c("id") % 3 == 1, "<div>Amazon Web Ltd.</div>").otherwise("")
    card = F.concat(F.lit("<div><table><tr><td><a href='https://x.awstrack.me/L0/https:%252F%252Fwww.amazon.jobs%252Fen%252Fjobs%252F"), number, F.lit("%252Fdev/1'>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</a><div>"), _escaped(F.coalesce("location", F.lit(""))), F.lit(", Israel</div>"), company, F.lit("<div>Basic Qualifications</div></td></tr></table><a href='https://a.example'>other</a></div>"))
    rows = read(spark, d, "jobs").filter(F.expr(_spark(f"{_TITLED} AND {_PLACED}"))).select("id", F.col("id").cast("string").alias("path"), _eml("noreply@mail.amazon.jobs", "Recommended Amazon jobs for you", card).alias("content"))
    jobs = mail.to_jobs(mail.read_cards(rows, "store_mail"), "amazon_email", "mail", 0.9)
    return jobs.select(F.col("source_message_id").alias("job_id"), "title", "company", "location", "message_date", "job_url")


def _spark(sql: str) -> str:
    """The conditions above in Spark's spelling."""
    return sql.replace("\\s+", "\\\\s+").replace(", 'g')", ")").replace("starts_with", "startswith").replace("regexp_matches", "regexp_like")


@query(f"SELECT CAST(10000000 + id AS VARCHAR) AS job_id, {_collapsed('title')} AS title, {_collapsed("location || ', Exampleland'")} AS location, {_collapsed('title')} || chr(10) || {_collapsed("location || ', Exampleland'")} || chr(10) || 'Job ID: ' || (10000000 + id) || chr(10) || 'Write to or call' AS raw_text FROM jobs WHERE {_TITLED} AND {_PLACED}")
def pasted_cards(spark, d):
    """Pasted text of two cards each: the first ends where the title of the next begins; contacts are taken out."""
    c = F.col
    one = F.concat(c("title"), F.lit("\n"), c("location"), F.lit(", Exampleland\n|\nJob ID: "), (c("id") + 10_000_000).cast("string"), F.lit("\nWrite to ann@x.example or call +44 20 7946 0000 https://a.example/1\n"))
    text = F.concat(one, F.lit("Next role\nBerlin, Germany\nJob ID: 99999\n"))
    rows = read(spark, d, "jobs").filter(F.expr(_spark(f"{_TITLED} AND {_PLACED}"))).select("id", F.col("id").cast("string").alias("path"), text.alias("content"))
    jobs = mail.to_jobs(mail.read_cards(rows, "pasted"), "amazon_text", "pasted", 0.9)
    return jobs.filter("source_message_id <> '99999'").select(F.col("source_message_id").alias("job_id"), "title", "location", "raw_text")


@query(f"SELECT DISTINCT source_id, {_normal('job_url')} AS job_url FROM public_postings WHERE starts_with(job_url, 'https://') AND regexp_extract(lower(job_url), '^https://([^/]*)', 1) = (SELECT min(regexp_extract(lower(p.job_url), '^https://([^/]*)', 1)) FROM public_postings p WHERE p.source_id = public_postings.source_id AND starts_with(p.job_url, 'https://'))")
def sitemap_reader(spark, d):
    """A sitemap of each source with all its addresses, of which those of its first host are wanted."""
    rows = read(spark, d, "public_postings").filter("startswith(job_url, 'https://')").select("source_id", "job_url").distinct()
    entry = F.concat(F.lit("<url><loc> "), F.regexp_replace("job_url", "&", "&amp;"), F.lit(" </loc></url>"))
    # A sitemap has at most 50,000 addresses by its standard; a source of more has several.
    part = F.pmod(F.xxhash64("job_url"), F.lit(4))
    hosts = rows.groupBy("source_id").agg(F.min(t.url_host(F.col("job_url"))).alias("host"))
    listed = rows.withColumn("own", t.url_host(F.col("job_url"))).join(hosts, "source_id").groupBy("source_id", "host", part.alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("urls"), F.max((F.col("own") == F.col("host")).cast("int")).alias("some"))
    xml = listed.filter("some = 1").select("source_id", "host", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("urls"), F.lit("</urlset>")).alias("payload"))
    return feeds.sitemap_urls(xml).select("source_id", "job_url")


@query("SELECT DISTINCT source_job_id, title, CASE WHEN source_id LIKE 'greenhouse%' THEN 'greenhouse' ELSE 'lever' END AS adapter FROM (SELECT source_id, source_job_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM public_postings WHERE job_url IS NOT NULL AND trim(source_job_id) <> '') WHERE title <> ''")
def landed_feeds(spark, d):
    """Payloads left by a downloader as numbered pages of each source, read from their folder and sent to their adapter."""
    import uuid

    from vacantia.tables import checkpoint_dir

    c = F.col
    base = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    rows = read(spark, d, "public_postings").dropDuplicates(["source_job_id"]).withColumn("page", F.pmod(F.xxhash64("source_job_id"), F.lit(2)))
    green = F.to_json(F.struct(F.collect_list(F.struct(c("source_job_id").alias("id"), "title", c("job_url").alias("absolute_url"))).alias("jobs")))
    lever = F.to_json(F.collect_list(F.struct(c("source_job_id").alias("id"), c("title").alias("text"), c("job_url").alias("hostedUrl"))))
    files = rows.groupBy("source_id", "page").agg(green.alias("g"), lever.alias("l")).withColumn("is_green", c("source_id").startswith("greenhouse")).select("source_id", "page", "is_green", F.when(c("is_green"), c("g")).otherwise(c("l")).alias("value"))
    feeds.land(files.select(F.url_encode("source_id").alias("source_id"), "page", "value"), base)
    sources = files.select("source_id", F.when(c("is_green"), "greenhouse").otherwise("lever").alias("adapter")).distinct()
    return feeds.dispatched(feeds.landed(spark, base), sources).select("source_job_id", "title", "adapter")


QUERIES, ORACLE = query.queries, query.oracle

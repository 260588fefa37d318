"""Queries of text functions and deterministic analysis."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vacantia.functions import analysis as a
from vacantia.functions import text as t
from vacantia.operators import records
from vacantia.plans.register import Register
from vacantia.tables import read, spread

query = Register()
_FOLD = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"


def _normal(url: str) -> str:
    clean = f"regexp_replace(trim({url}), '[.,;:!?)\\]}}\"'']+$', '')"
    part = lambda k: f"regexp_extract({clean}, '^(https?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', {k})"
    keys = ", ".join(f"'{k}'" for k in t.TRACKING_KEYS)
    kept = f"list_filter(string_split({part(4)}, '&'), lambda s: s <> '' AND NOT starts_with(lower(split_part(s, '=', 1)), 'utm_') AND lower(split_part(s, '=', 1)) NOT IN ({keys}))"
    return f"(lower({part(1)}) || '://' || lower({part(2)}) || CASE WHEN {part(3)} = '/' THEN '/' ELSE rtrim({part(3)}, '/') END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


@query(f"SELECT id, {_normal('job_url')} AS url FROM jobs WHERE job_url IS NOT NULL")
def url_normalize(spark, d):
    return read(spark, d, "jobs").filter("job_url is not null").select("id", t.normalize_url(F.col("job_url")).alias("url"))


@query(f"SELECT id, sha256('url:' || lower({_normal('job_url')})) AS url_key FROM jobs WHERE job_url IS NOT NULL")
def url_identity(spark, d):
    return read(spark, d, "jobs").filter("job_url is not null").select("id", t.url_identity(F.col("job_url")).alias("url_key"))


@query("SELECT regexp_extract(lower(final_url), '^[a-z]+://([^/?#:]*)', 1) AS host, count(*) AS pages FROM job_details GROUP BY 1")
def url_host_counts(spark, d):
    return read(spark, d, "job_details").groupBy(t.url_host(F.col("final_url")).alias("host")).agg(F.count("*").alias("pages"))


@query("""
SELECT id, u AS url, u LIKE 'https://careers.%' AS careers FROM (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(raw_text, 'https?://[^\\s<>()]+'), lambda x: regexp_replace(x, '[.,;:!?)\\]}"'']+$', '')))) AS u FROM job_postings WHERE raw_text IS NOT NULL)""")
def visible_urls(spark, d):
    rows = read(spark, d, "job_postings").filter("raw_text is not null").select("id", F.explode(t.visible_urls(F.col("raw_text"))).alias("url"))
    return rows.withColumn("careers", F.col("url").startswith("https://careers."))


@query("SELECT job_id, regexp_extract(lower(final_url), '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_matches(lower(final_url), '^[a-z]+://([^/?#:]*\\.)?example\\.org([:/?#]|$)') AS board FROM job_details")
def host_suffix(spark, d):
    host = t.url_host(F.col("final_url"))
    return read(spark, d, "job_details").select("job_id", host.alias("host"), t.host_within(host, ["example.org"]).alias("board"))


@query(f"SELECT id, {_FOLD.format('title')} AS title_text, {_FOLD.format('company')} AS company_text FROM jobs")
def text_normalize(spark, d):
    return read(spark, d, "jobs").select("id", t.fingerprint_text(F.col("title")).alias("title_text"), t.fingerprint_text(F.col("company")).alias("company_text"))


@query(f"""
SELECT id, CASE WHEN {_FOLD.format('title')} <> '' AND {_FOLD.format('company')} <> '' AND {_FOLD.format('location')} <> ''
THEN sha256('position:' || {_FOLD.format('title')} || '|' || {_FOLD.format('company')} || '|' || {_FOLD.format('location')}) END AS position_key FROM jobs""")
def position_fingerprints(spark, d):
    c = F.col
    return read(spark, d, "jobs").select("id", t.position_fingerprint(c("title"), c("company"), c("location")).alias("position_key"))


@query(f"""
SELECT source_group, source_message_id, sha256(CASE WHEN coalesce(job_url, '') <> '' THEN 'url:' || lower(trim(job_url)) WHEN {_FOLD.format('title')} <> '' AND {_FOLD.format('company')} <> '' AND {_FOLD.format('location')} <> ''
THEN 'text:' || {_FOLD.format('title')} || '|' || {_FOLD.format('company')} || '|' || {_FOLD.format('location')} ELSE 'source:' || {_FOLD.format('source')} || '|' || {_FOLD.format('source_group')} || '|' || lower(trim(source_message_id)) END) AS dedupe_key FROM normalized_jobs""")
def dedupe_keys(spark, d):
    c = F.col
    return read(spark, d, "normalized_jobs").select("source_group", "source_message_id", t.dedupe_key(c("job_url"), c("title"), c("company"), c("location"), c("source"), c("source_group"), c("source_message_id")).alias("dedupe_key"))


@query("""
WITH l AS (SELECT job_id, i, trim(regexp_replace(string_split(description_text, chr(10))[i], '[ \\t]+', ' ', 'g')) AS line FROM (SELECT job_id, description_text, unnest(range(1, len(string_split(description_text, chr(10))) + 1)) AS i FROM job_details WHERE description_text IS NOT NULL)),
k AS (SELECT *, lag(line) OVER (PARTITION BY job_id ORDER BY i) AS before FROM l WHERE line <> '')
SELECT d.job_id, coalesce(p.page_text, '') AS page_text FROM job_details d LEFT JOIN (SELECT job_id, substring(string_agg(line, chr(10) ORDER BY i), 1, 60000) AS page_text FROM k WHERE before IS DISTINCT FROM line GROUP BY job_id) p ON p.job_id = d.job_id WHERE d.description_text IS NOT NULL""")
def page_text(spark, d):
    return read(spark, d, "job_details").filter("description_text is not null").select("job_id", t.page_text(F.col("description_text")).alias("page_text"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256({_FOLD.format('text')}) HAVING count(*) > 1")
def text_dedup_exact(spark, d):
    key = t.sha(t.fingerprint_text(F.col("text")))
    return read(spark, d, "documents").filter("text is not null").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").select("doc_id", "copies")


def _has(column: str, words: list[str]) -> str:
    one = "|".join(re.escape(w).replace("\\ ", " ").replace("'", "''") for w in words)
    return f"regexp_matches({column}, '(^|[^a-z0-9])({one})([^a-z0-9]|$)')"


def _named(name: str, words: list[str]) -> str:
    """SQL of whether a technology is named; Spring isn't where it only stands in Spring Boot."""
    if name != "Spring":
        return _has("x", words)
    return f"({_has('x', words)} AND (NOT {_has('x', a.TECHNOLOGIES['Spring Boot'])} OR {_has("replace(x, 'spring boot', '')", ['spring'])}))"


@query("WITH x AS (SELECT " + _FOLD.format("text") + " AS x FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS technology, count(*) AS documents FROM x WHERE {_named(n, w)} HAVING count(*) > 0" for n, w in a.TECHNOLOGIES.items()))
def technology_counts(spark, d):
    found = a.technologies(t.analysis_text(F.col("text")))
    return spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.explode(found).alias("technology")).groupBy("technology").agg(F.count("*").alias("documents"))


@query("WITH x AS (SELECT doc_id, " + _FOLD.format("text") + " AS x FROM documents) SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {_has('x', w)} THEN '{n}' END" for n, w in a.SENIORITY.items()) + "], lambda s: s IS NOT NULL)::VARCHAR AS signals FROM x")
def seniority_signals(spark, d):
    found = t.alias_groups(t.analysis_text(F.col("text")), a.SENIORITY)
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("signals"))


@query("WITH x AS (SELECT doc_id, " + _FOLD.format("text") + " AS x FROM documents) SELECT doc_id FROM x WHERE " + _has("x", ["pension plan", "stock options", "home-office grant"]))
def keyword_match(spark, d):
    return read(spark, d, "documents").filter(t.phrase(t.analysis_text(F.col("text")), "pension plan", "stock options", "home-office grant")).select("doc_id")


@query("WITH x AS (SELECT doc_id, " + _FOLD.format("text") + " AS x FROM documents) SELECT doc_id, least(5, " + " + ".join(f"CASE WHEN {_has('x', [w])} THEN {n} ELSE 0 END" for w, n in {"python": 3, "kafka": 2, "docker": 2, "rust": 1}.items()) + ") AS score FROM x")
def keyword_score(spark, d):
    return read(spark, d, "documents").select("doc_id", t.keyword_score(t.scoring_text(F.col("text")), {"python": 3, "kafka": 2, "docker": 2, "rust": 1}, 5).alias("score"))


_ANALYSIS = "trim(regexp_replace(replace(replace(replace(replace(lower(coalesce({0}, '')), chr(8211), '-'), chr(8212), '-'), chr(8217), chr(39)), '`', chr(39)), '[\\s' || chr(160) || ']+', ' ', 'g'))"
_LISTED = lambda groups: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_named(n, w)} THEN '{n}' END" for n, w in groups.items()) + "], lambda s: s IS NOT NULL), '|')"
_YEARS = f"""
x AS MATERIALIZED (SELECT job_id, length(description_text) AS size, {_ANALYSIS.format('description_text')} AS x FROM job_details WHERE description_text IS NOT NULL),
f AS (SELECT job_id, f FROM (SELECT job_id, unnest(regexp_split_to_array(x, '[.!?;]\\s+|\\s+[•●▪]\\s+')) AS f FROM x WHERE contains(x, 'year') OR contains(x, 'yr')) WHERE (contains(f, 'year') OR contains(f, 'yr')) AND {_has('f', a.EXPERIENCE_CONTEXT)}),
c AS (SELECT job_id, 0 AS lo, 0 AS hi FROM x WHERE regexp_matches(x, '{a.NONE_NEEDED}')
UNION ALL SELECT job_id, CAST(lo AS INT), CAST(hi AS INT) FROM (SELECT job_id, unnest(regexp_extract_all(f, '{a.RANGE}', 1)) AS lo, unnest(regexp_extract_all(f, '{a.RANGE}', 2)) AS hi FROM f)
{" ".join(f"UNION ALL SELECT job_id, CAST(lo AS INT), NULL FROM (SELECT job_id, unnest(regexp_extract_all(f, '{p}', 1)) AS lo FROM f)" for p in a.OPEN_ENDED)}),
k AS (SELECT job_id, least(lo, coalesce(hi, lo)) AS lo, CASE WHEN hi IS NULL THEN 99 ELSE greatest(lo, hi) END AS hi, coalesce(greatest(lo, hi), lo) AS most FROM c),
y AS (SELECT job_id, lo, nullif(hi, 99) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY lo DESC, hi DESC) AS n FROM k WHERE most <= {a.MOST_YEARS}) WHERE n = 1),
v AS (SELECT x.job_id, x.size, y.lo, y.hi, {_LISTED(a.TECHNOLOGIES)} AS technologies, {_LISTED(a.SENIORITY)} AS seniority, {_LISTED(a.EDUCATION)} AS education FROM x LEFT JOIN y ON y.job_id = x.job_id),
w AS (SELECT *, '|' || seniority || '|' AS s FROM v),
r AS (SELECT *, CASE WHEN contains(s, '|student|') THEN 'student' WHEN contains(s, '|intern|') THEN 'intern' WHEN contains(s, '|senior|') THEN 'senior' WHEN contains(s, '|junior|') THEN 'junior' WHEN lo IS NULL THEN 'not-specified' WHEN lo <= 1 THEN 'entry-level' WHEN lo <= 3 THEN 'junior-to-mid' WHEN lo <= 5 THEN 'mid-level' ELSE 'senior' END AS label FROM w)"""


def _analysed(spark, d):
    rows = spread(read(spark, d, "job_details").filter("description_text is not null").select("job_id", "description_text"), "job_id")
    return a.analysed(rows, "description_text")


@query(f"""
WITH {_YEARS} SELECT job_id, lo AS experience_min, hi AS experience_max, CASE WHEN lo IS NULL THEN 'not specified' WHEN hi IS NULL THEN lo || '+ years' WHEN lo = hi THEN lo || ' years' ELSE lo || '-' || hi || ' years' END AS experience_text, label AS experience_label, technologies, seniority AS seniority_signals, education AS education_signals,
(35 + CASE WHEN size >= 500 THEN 15 ELSE 0 END + CASE WHEN size >= 1500 THEN 10 ELSE 0 END + CASE WHEN technologies <> '' THEN 15 ELSE 0 END + CASE WHEN lo IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN seniority <> '' THEN 5 ELSE 0 END + CASE WHEN education <> '' THEN 5 ELSE 0 END) / 100.0::DOUBLE AS analysis_confidence FROM r""")
def description_analysis(spark, d):
    """The whole analysis of every fetched page."""
    lists = [F.array_join(c, "|").alias(c) for c in ("technologies", "seniority_signals", "education_signals")]
    return _analysed(spark, d).select("job_id", "experience_min", "experience_max", t.experience_text(F.col("experience_min"), F.col("experience_max")).alias("experience_text"), "experience_label", *lists, "analysis_confidence")


@query(f"WITH {_YEARS} SELECT label AS experience_label, count(*) AS pages FROM r GROUP BY 1")
def experience_counts(spark, d):
    return _analysed(spark, d).groupBy("experience_label").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "experience_label")


_FITS = {"degree-required": 0.7, "degree-preferred": 0.5, "degree-mentioned": 0.25}


@query(f"WITH {_YEARS} SELECT job_id, list_max(list_filter([" + ", ".join(f"CASE WHEN contains('|' || education || '|', '|{n}|') THEN {v}::DOUBLE END" for n, v in _FITS.items()) + "], lambda v: v IS NOT NULL)) AS fit FROM r")
def education_fit(spark, d):
    rows = spread(read(spark, d, "job_details").filter("description_text is not null").select("job_id", "description_text"), "job_id")
    return rows.select("job_id", t.greatest_fit(t.alias_groups(t.analysis_text(F.col("description_text")), a.EDUCATION), _FITS).alias("fit"))


@query("""
SELECT id, CAST(coalesce(try_strptime(trim(posted_on), '%d-%m-%Y'), try_strptime(trim(posted_on), '%d/%m/%Y'), try_strptime(trim(posted_on), '%Y-%m-%d')) AS DATE) AS day FROM jobs WHERE posted_on IS NOT NULL""")
def date_parse(spark, d):
    return read(spark, d, "jobs").filter("posted_on is not null").select("id", t.posted_date(F.col("posted_on")).alias("day"))


@query("SELECT id, CAST(make_timestamp(CAST(posted_on AS BIGINT) * 1000) AS DATE) AS day FROM jobs WHERE regexp_full_match(posted_on, '[0-9]{13}')")
def epoch_dates(spark, d):
    rows = read(spark, d, "jobs").filter(F.col("posted_on").rlike("^[0-9]{13}$"))
    return rows.select("id", t.epoch_millis_date(F.col("posted_on").cast("bigint")).alias("day"))


@query("""
WITH x AS (SELECT id, string_split(raw_text, chr(10))[1] AS line FROM job_postings WHERE raw_text IS NOT NULL)
SELECT id, CASE WHEN contains(line, ' @ ') THEN trim(regexp_extract(line, '^(.*) @ (.*)$', 1)) ELSE trim(line) END AS title, CASE WHEN contains(line, ' @ ') THEN nullif(trim(regexp_extract(line, '^(.*) @ (.*)$', 2)), '') END AS company FROM x""")
def title_and_company(spark, d):
    title, company = t.split_title_and_company(F.col("line"))
    rows = read(spark, d, "job_postings").filter("raw_text is not null").select("id", F.element_at(F.split("raw_text", "\n"), 1).alias("line"))
    return rows.select("id", title.alias("title"), company.alias("company"))


@query("""
WITH x AS (SELECT id, list_filter(string_split(raw_text, chr(10)), lambda x: starts_with(lower(trim(x)), 'location:')) AS hits FROM job_postings)
SELECT id, nullif(trim(regexp_replace(hits[len(hits)], '^[^:]*:', '')), '') AS place FROM x WHERE len(hits) > 0""")
def labelled_lines(spark, d):
    rows = read(spark, d, "job_postings").select("id", F.split("raw_text", "\n").alias("lines"))
    return rows.filter(F.exists("lines", lambda x: F.lower(F.trim(x)).startswith("location:"))).select("id", t.labelled(F.col("lines"), "location").alias("place"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT coalesce(source, '') AS source, count(*) AS jobs FROM normalized_jobs WHERE TRY_CAST(substring(message_date, 1, 10) AS DATE) >= DATE '2025-06-01' AND regexp_matches(message_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') GROUP BY 1")
def since_date(spark, d):
    rows = records.since(read(spark, d, "normalized_jobs"), "message_date", F.lit("2025-06-01").cast("date"), strict=False)
    return rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("jobs"))


_WORDS = {"python": 3, "kafka": 2, "docker": 2, "rust": 1}


@query("WITH x AS (SELECT doc_id, " + _FOLD.format("text") + " AS x FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has('x', [w])} THEN '{w}' END" for w in _WORDS) + "], lambda s: s IS NOT NULL), ',') AS found FROM x")
def matching_keywords(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(t.matching(t.scoring_text(F.col("text")), list(_WORDS), t.keyword), ",").alias("found"))


@query("SELECT event_id, greatest(-10.0, least(10.0, value - 20)) AS bonus FROM events")
def bounded_values(spark, d):
    return read(spark, d, "events").select("event_id", t.bounded(F.col("value") - 20, -10.0, 10.0).alias("bonus"))


@query(f"SELECT arg_min(location, id) AS term, min(id) AS first_id FROM jobs WHERE {_FOLD.format('location')} <> '' GROUP BY {_FOLD.format('location')}")
def distinct_terms(spark, d):
    rows = read(spark, d, "jobs").select("id", "location")
    return records.distinct_terms(rows, "location", t.fingerprint_text(F.col("location")), "id").select(F.col("location").alias("term"), F.col("id").alias("first_id"))


@query("""
SELECT source_group, source_message_id, array_to_string(urls, ' ') AS urls, 'none' AS broken, 'none' AS other FROM source_messages""")
def json_lists(spark, d):
    joined = lambda c: F.when(F.size(t.json_strings(c)) > 0, F.array_join(t.json_strings(c), " ")).otherwise("none")
    text = F.to_json("urls")
    rows = read(spark, d, "source_messages").filter("urls is not null").select("source_group", "source_message_id", F.array_join(t.json_strings(text), " ").alias("urls"), joined(F.concat(text, F.lit("]"))).alias("broken"), joined(F.concat(F.lit('{"a":'), text, F.lit("}"))).alias("other"))
    return rows.unionByName(read(spark, d, "source_messages").filter("urls is null").select("source_group", "source_message_id", F.lit(None).cast("string").alias("urls"), F.lit("none").alias("broken"), F.lit("none").alias("other")))


@query("SELECT job_id, sum(id) AS ids, string_agg(source, ',' ORDER BY id) AS sources FROM job_postings GROUP BY job_id, source_group")
def json_objects(spark, d):
    rows = read(spark, d, "job_postings").groupBy("job_id", "source_group").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "source")))).alias("v"))
    found = t.json_objects(F.col("v"), "id bigint, source string")
    return rows.select("job_id", F.aggregate(found, F.lit(0).cast("bigint"), lambda n, x: n + x["id"]).alias("ids"), F.array_join(F.transform(found, lambda x: x["source"]), ",").alias("sources"))


@query("SELECT source_job_id, array_to_string(list_filter(['XA', 'XB'], lambda c: NOT list_contains(coalesce(country_codes, []), c)), ',') AS missing FROM public_postings")
def missing_codes(spark, d):
    return read(spark, d, "public_postings").select("source_job_id", F.array_join(t.missing_keys(F.col("country_codes"), ["XA", "XB"]), ",").alias("missing"))


@query("""
SELECT id, u AS url, NOT regexp_matches(u, '//(10[.]|localhost|172[.]1[67][.]|192[.]168[.]|169[.]254[.])') AS public, CASE WHEN u LIKE 'https://jobs.%' AND regexp_matches(u, '^https://[^/:@]*/') THEN u END AS own
FROM (SELECT id, CASE id % 7 WHEN 0 THEN 'http://10.0.0.' || id % 250 || '/x' WHEN 1 THEN 'http://localhost/' || id WHEN 2 THEN 'https://172.16.3.' || id % 250 || '/' WHEN 3 THEN 'http://192.168.1.' || id % 250 WHEN 4 THEN 'http://169.254.1.' || id % 250 ELSE job_url END AS u FROM jobs WHERE job_url IS NOT NULL)""")
def public_urls(spark, d):
    """Addresses of jobs beside private ones made from ids, so that both outcomes occur."""
    n, rest = F.col("id") % 7, (F.col("id") % 250).cast("string")
    u = F.when(n == 0, F.concat(F.lit("http://10.0.0."), rest, F.lit("/x"))).when(n == 1, F.concat(F.lit("http://localhost/"), F.col("id").cast("string"))).when(n == 2, F.concat(F.lit("https://172.16.3."), rest, F.lit("/"))).when(n == 3, F.concat(F.lit("http://192.168.1."), rest)).when(n == 4, F.concat(F.lit("http://169.254.1."), rest)).otherwise(F.col("job_url"))
    rows = read(spark, d, "jobs").filter("job_url is not null").select("id", u.alias("url"))
    own = F.when(t.url_host(F.col("url")).startswith("jobs."), t.expected_https_url(F.col("url"), t.url_host(F.col("url")), "/"))
    return rows.select("id", "url", t.is_public_url(F.col("url")).alias("public"), own.alias("own"))


QUERIES, ORACLE = query.queries, query.oracle

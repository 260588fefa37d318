"""Queries of the problems of training data, p1 to p10 without p4, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import boilerplate, employers, layout, locations, mixing, packing, pii, residue, survivors, truncation
from vacantia.plans.dates import READ
from vacantia.tables import read


def _group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.group_rows(*(read(spark, sf_dir, t) for t in ("job_groups", "jobs", "job_postings", "source_trust", "source_groups")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(_group_rows(spark, sf_dir)).select("group_id", "title_job_id", "source_posting_id", "latest_posting_id")


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.fused(_group_rows(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.found(*(read(spark, sf_dir, t) for t in ("jobs", "public_postings", "location_catalogue")))


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each typed value that means no entry occurs."""
    jobs = read(spark, sf_dir, "jobs").select("location").unionByName(read(spark, sf_dir, "public_postings").select("location"))
    rows = locations.resolved(jobs.groupBy("location").agg(F.count("*").alias("n")), read(spark, sf_dir, "location_catalogue"), "location")
    return rows.filter("location_id = 0").select("location", "n")


def p7_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry within the distance of each typed value."""
    values = read(spark, sf_dir, "jobs").select("location").unionByName(read(spark, sf_dir, "public_postings").select("location"))
    return locations.candidates(values.withColumnRenamed("location", "value"), read(spark, sf_dir, "location_catalogue"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(read(spark, sf_dir, "job_postings"), read(spark, sf_dir, "source_messages"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders."""
    rows = pii.texts(read(spark, sf_dir, "job_postings"), read(spark, sf_dir, "source_messages"))
    return rows.select("source_table", "row_key", pii.redacted("text").alias("redacted_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employers.found(read(spark, sf_dir, "jobs"), read(spark, sf_dir, "normalized_jobs"))


def p1_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the key of its employer and the number of spellings that employer has."""
    linked = employers.employers(employers.names_of(read(spark, sf_dir, "jobs"), read(spark, sf_dir, "normalized_jobs")))
    sizes = linked.groupBy("employer").agg(F.count("*").alias("spellings"))
    return linked.join(sizes, "employer").select("name", "employer", "spellings")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = read(spark, sf_dir, "job_details")
    return boilerplate.found(details)


def p3_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each page, and its main body."""
    rows = read(spark, sf_dir, "job_details").filter("description_text is not null")
    table, _ = boilerplate.statistics(rows)
    return rows.select("job_id", layout.rendered("description_text").alias("visible_text"), boilerplate.main_body(table)("description_text").alias("main_text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(read(spark, sf_dir, "job_details"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(read(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(read(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pack_sizes"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p8_packed(spark, sf_dir), read(spark, sf_dir, "pack_sizes"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*mixing.mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets")))


QUERIES = {"p8_packed": p8_packed, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares, "p3_found": p3_found, "p3_rendered": p3_rendered, "p5_found": p5_found, "p10_found": p10_found, "p10_rates": p10_rates, "p1_found": p1_found, "p1_spellings": p1_spellings, "p2_found": p2_found, "p2_redacted": p2_redacted, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_found": p7_found, "p7_unmatched": p7_unmatched, "p7_candidates": p7_candidates}
_TITLES = ", ".join("'" + t.replace("'", "''") + "'" for t in survivors.PLACEHOLDER_TITLES)
_P6 = f"""
WITH RECURSIVE {READ}, rows AS (SELECT g.group_id, g.job_id, p.id, p.source, j.title, coalesce(t.trust_rank, {survivors.UNRANKED}) AS trust, CASE WHEN isnan(p.parse_confidence) THEN NULL ELSE p.parse_confidence END AS sure, i.micros,
regexp_matches(lower(trim(coalesce(j.title, ''))), '\\p{{L}}{{2}}') AND lower(trim(j.title)) NOT IN ({_TITLES}) AS named
FROM (SELECT DISTINCT group_id, job_id FROM job_groups) g LEFT JOIN job_postings p ON p.job_id = g.job_id LEFT JOIN jobs j ON j.id = g.job_id LEFT JOIN (SELECT source, min(trust_rank) AS trust_rank FROM source_trust GROUP BY source) t ON t.source = p.source LEFT JOIN instants i ON i.source_table = 'job_postings' AND i.row_key = CAST(p.id AS VARCHAR)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY id IS NULL, trust, sure DESC NULLS LAST, micros DESC NULLS LAST, id) AS a, row_number() OVER (PARTITION BY group_id ORDER BY micros IS NULL, micros DESC, id) AS b, row_number() OVER (PARTITION BY group_id ORDER BY id IS NULL OR NOT named, trust, sure DESC NULLS LAST, micros DESC NULLS LAST, id) AS c FROM rows)
SELECT group_id, coalesce(max(job_id) FILTER (c = 1 AND named AND id IS NOT NULL), 0) AS title_job_id, coalesce(max(id) FILTER (a = 1), 0) AS source_posting_id, coalesce(max(id) FILTER (b = 1 AND micros IS NOT NULL), 0) AS latest_posting_id FROM ranked GROUP BY group_id"""


def _current(field: str, where: str = "TRUE") -> str:
    """CTEs that end in ``{field}_out`` (group_id, value, reasoned): the currency reasoning of ``survivors`` in SQL."""
    f = field
    return f"""
{f}_role AS (SELECT * FROM rows WHERE {where}),
{f}_since AS (SELECT group_id, {f} AS value, min(micros) AS since FROM {f}_role WHERE micros IS NOT NULL AND {f} IS NOT NULL GROUP BY ALL),
{f}_steps AS (SELECT before AS earlier, value AS later, count(*) AS votes FROM (SELECT value, lag(value) OVER (PARTITION BY group_id ORDER BY since, value) AS before FROM {f}_since) WHERE before <> value GROUP BY ALL),
{f}_arcs AS (SELECT s.earlier, s.later FROM {f}_steps s LEFT JOIN {f}_steps b ON b.earlier = s.later AND b.later = s.earlier WHERE s.votes >= 2 AND s.votes > coalesce(b.votes, 0)),
{f}_reach AS (SELECT earlier, later FROM {f}_arcs UNION SELECT r.earlier, a.later FROM {f}_reach r JOIN {f}_arcs a ON a.earlier = r.later),
{f}_values AS (SELECT group_id, {f} AS value, max(micros) AS last_at, arg_min(id, (-micros, id)) FILTER (micros IS NOT NULL) AS first_id FROM {f}_role WHERE {f} IS NOT NULL GROUP BY ALL),
{f}_top AS (SELECT group_id, arg_min(value, (-last_at, first_id)) AS top FROM {f}_values WHERE last_at IS NOT NULL GROUP BY group_id),
{f}_held AS (SELECT v.group_id, v.value, v.last_at IS NOT NULL AS dated, t.top FROM {f}_values v LEFT JOIN {f}_top t ON t.group_id = v.group_id),
{f}_pairs AS (SELECT a.group_id, a.value AS earlier, b.value AS later, a.dated AS from_dated, b.dated AS to_dated FROM {f}_held a JOIN {f}_reach r ON r.earlier = a.value JOIN {f}_held b ON b.group_id = a.group_id AND b.value = r.later WHERE (NOT a.dated OR a.value = a.top) AND a.value <> b.value AND NOT (a.dated AND b.dated)),
{f}_open AS (SELECT group_id, value FROM {f}_held h WHERE NOT dated AND (top IS NULL OR EXISTS (SELECT 1 FROM {f}_pairs p WHERE p.group_id = h.group_id AND p.later = h.value AND p.from_dated) AND NOT EXISTS (SELECT 1 FROM {f}_pairs p WHERE p.group_id = h.group_id AND p.earlier = h.value AND p.to_dated))),
{f}_beaten AS (SELECT p.group_id, p.earlier AS value FROM {f}_pairs p JOIN {f}_open o ON o.group_id = p.group_id AND o.value = p.later WHERE NOT from_dated AND NOT to_dated AND NOT EXISTS (SELECT 1 FROM {f}_pairs q WHERE q.group_id = p.group_id AND q.earlier = p.later AND q.later = p.earlier)),
{f}_last AS (SELECT group_id, min(value) AS last FROM {f}_open o WHERE NOT EXISTS (SELECT 1 FROM {f}_beaten b WHERE b.group_id = o.group_id AND b.value = o.value) GROUP BY group_id),
{f}_out AS (SELECT g.group_id, coalesce(l.last, t.top) AS value, CASE WHEN coalesce(l.last, t.top) IS NOT NULL THEN l.last IS NOT NULL END AS reasoned FROM (SELECT DISTINCT group_id FROM {f}_role) g LEFT JOIN {f}_top t ON t.group_id = g.group_id LEFT JOIN {f}_last l ON l.group_id = g.group_id)"""


_P6_ALL = _P6.replace("SELECT group_id, coalesce(max(job_id)", f"chosen AS (SELECT group_id, coalesce(max(job_id)", 1).replace("FROM ranked GROUP BY group_id", "FROM ranked GROUP BY group_id)", 1)
_P6_ALL = f"""{_P6_ALL.replace("chosen AS", ", chosen AS", 1)},{_current("source")},{_current("title", "named")}
SELECT c.*, s.value AS current_source, s.reasoned AS source_reasoned, t.value AS current_title, t.reasoned AS title_reasoned FROM chosen c LEFT JOIN source_out s ON s.group_id = c.group_id LEFT JOIN title_out t ON t.group_id = c.group_id"""
ORACLE: dict[str, str] = {"p6_found": _P6, "p6_survivors": _P6_ALL}

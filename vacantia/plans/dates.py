"""Queries of problem 4, mixed timestamp notations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import timestamps
from vacantia.operators.timestamps import ABBREVIATIONS, MONTH_NUMBER
from vacantia.plans.register import Register
from vacantia.tables import read

query = Register()
_NAMES = "|".join(sorted(MONTH_NUMBER, key=lambda n: (-len(n), n)))
_B, _TIME = "[\\s\u00a0\u202f]", "[t,]?[\\s\u00a0\u202f]*(?:at[\\s\u00a0\u202f]+)?"


def _in(names: dict[str, int], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in names.items()) + " END"


#: Date and rest of a value by the form of its date; the rest is one clock with zone for all of them.
_FORMS = f"""
SELECT *, CASE WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([^0-9]|$)') THEN regexp_extract(v, '^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(.*)$', ['y', 'm', 'd', 'rest'])
WHEN regexp_matches(v, '^[0-9]{{4}}[/.][0-9]{{1,2}}[/.][0-9]{{1,2}}([^0-9]|$)') THEN regexp_extract(v, '^([0-9]{{4}})[/.]([0-9]{{1,2}})[/.]([0-9]{{1,2}})(.*)$', ['y', 'm', 'd', 'rest'])
WHEN regexp_matches(v, '^[0-9]{{8}}$') THEN regexp_extract(v, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})()$', ['y', 'm', 'd', 'rest'])
WHEN regexp_matches(v, '^[0-9]{{8}}t[0-9]{{6}}') THEN regexp_extract(regexp_replace(v, '^(.{{8}})t(..)(..)(..)', '\\1t\\2:\\3:\\4'), '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(.*)$', ['y', 'm', 'd', 'rest'])
WHEN regexp_matches(v, '^[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.]([0-9]{{4}}|[0-9]{{2}})([^0-9]|$)') THEN CASE WHEN date_order = 'MDY' THEN regexp_extract(v, '^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}|[0-9]{{2}})(.*)$', ['m', 'd', 'y', 'rest']) ELSE regexp_extract(v, '^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}|[0-9]{{2}})(.*)$', ['d', 'm', 'y', 'rest']) END
WHEN regexp_matches(v, '^({_NAMES})[.]?{_B}+[0-9]') THEN regexp_extract(v, '^({_NAMES})[.]?{_B}+([0-9]{{1,2}})(?:st|nd|rd|th)?,?{_B}+([0-9]{{4}})(.*)$', ['m', 'd', 'y', 'rest'])
ELSE regexp_extract(v, '^(?:[a-zé]{{2,10}}[.]?,{_B}*)?([0-9]{{1,2}})(?:[.]|st|nd|rd|th|er)?{_B}+(?:de{_B}+)?({_NAMES})[.]?,?{_B}+(?:de{_B}+)?([0-9]{{4}})(.*)$', ['d', 'm', 'y', 'rest']) END AS p FROM values_in"""

_CLOCK = f"^(?:{_TIME}([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.,]([0-9]{{1,9}}))?)?(?:{_B}*([ap])[.]?m\\b[.]?)?(?:(?:{_B}*(z|[+-][0-9]{{2}}:?[0-9]{{2}}))?(?:{_B}*\\[?([a-z]+/[a-z_/+-]+|utc)\\]?)?|{_B}+([a-z]{{2,4}})))?$"
#: (source_table, row_key, value, date as written, instant in microseconds) of every value of the three tables.
READ = f"""
values_in AS (SELECT 'jobs' AS source_table, CAST(id AS VARCHAR) AS row_key, posted_on AS value, NULL AS tz, 'DMY' AS date_order, lower(regexp_replace(posted_on, '^{_B}+|{_B}+$', '', 'g')) AS v FROM jobs
UNION ALL SELECT 'job_postings', CAST(id AS VARCHAR), message_date, z.tz_name, z.date_order, lower(regexp_replace(message_date, '^{_B}+|{_B}+$', '', 'g')) FROM job_postings p LEFT JOIN source_groups z ON z.source_group = p.source_group
UNION ALL SELECT 'source_messages', p.source_group || '/' || source_message_id, message_date, z.tz_name, z.date_order, lower(regexp_replace(message_date, '^{_B}+|{_B}+$', '', 'g')) FROM source_messages p LEFT JOIN source_groups z ON z.source_group = p.source_group),
forms AS ({_FORMS}),
parts AS (SELECT *, CASE WHEN length(p.y) = 2 THEN 2000 + TRY_CAST(p.y AS INT) ELSE try_cast(p.y AS INT) END AS y, coalesce(try_cast(p.m AS INT), {_in(MONTH_NUMBER, 'p.m')}) AS m, try_cast(p.d AS INT) AS d, regexp_extract(p.rest, '{_CLOCK}', ['h', 'mi', 's', 'f', 'ap', 'off', 'zn', 'abbr']) AS c, regexp_matches(p.rest, '{_CLOCK}') AS good FROM forms),
clocks AS (SELECT *, CASE WHEN c.ap = '' THEN coalesce(try_cast(c.h AS INT), 0) WHEN TRY_CAST(c.h AS INT) NOT BETWEEN 1 AND 12 THEN 99 ELSE TRY_CAST(c.h AS INT) % 12 + CASE c.ap WHEN 'p' THEN 12 ELSE 0 END END AS h, coalesce(try_cast(c.mi AS INT), 0) AS mi, coalesce(try_cast(c.s AS INT), 0) AS s, TRY_CAST(substring(rpad(c.f, 9, '0'), 1, 6) AS BIGINT) AS us,
CASE WHEN c.off = 'z' THEN 0 WHEN c.off <> '' THEN CASE WHEN c.off[1] = '-' THEN -1 ELSE 1 END * (TRY_CAST(substring(c.off, 2, 2) AS INT) * 60 + TRY_CAST(right(c.off, 2) AS INT)) WHEN c.abbr <> '' THEN coalesce({_in({k.lower(): v for k, v in ABBREVIATIONS.items()}, 'c.abbr')}, 9999) END AS off,
coalesce((SELECT name FROM pg_timezone_names() z WHERE lower(z.name) = c.zn LIMIT 1), CASE WHEN c.zn = '' THEN coalesce(tz, 'UTC') END) AS zone FROM parts),
days AS (SELECT *, CASE WHEN good AND y BETWEEN 1900 AND 2199 AND m BETWEEN 1 AND 12 AND h <= 23 AND mi <= 59 AND s <= 59 AND coalesce(abs(off) <= 1080, TRUE) THEN try_cast(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) END AS day FROM clocks),
walls AS (SELECT *, day + INTERVAL (h * 3600 + mi * 60 + s) SECOND + INTERVAL (us) MICROSECOND AS wall FROM days),
sides AS (SELECT *, wall - (timezone(zone, timezone('UTC', wall - INTERVAL 1 DAY)) - (wall - INTERVAL 1 DAY)) AS early, wall - (timezone(zone, timezone('UTC', wall + INTERVAL 1 DAY)) - (wall + INTERVAL 1 DAY)) AS late FROM walls),
readings AS (SELECT source_table, row_key, value, CASE WHEN regexp_full_match(v, '[0-9]{{10}}') THEN TRY_CAST(v AS BIGINT) * 1000000 WHEN regexp_full_match(v, '[0-9]{{13}}') THEN TRY_CAST(v AS BIGINT) * 1000 WHEN regexp_full_match(v, '[0-9]{{16}}') THEN TRY_CAST(v AS BIGINT) END AS unix, day,
CASE WHEN off IS NOT NULL THEN epoch_us(wall) - CAST(off AS BIGINT) * 60000000 WHEN timezone(zone, timezone('UTC', early)) = wall OR timezone(zone, timezone('UTC', late)) <> wall THEN epoch_us(early) ELSE epoch_us(late) END AS micros FROM sides),
instants AS (SELECT source_table, row_key, value, CASE WHEN unix IS NOT NULL THEN CAST(make_timestamp(unix) AS DATE) ELSE day END AS day, coalesce(unix, CASE WHEN day IS NOT NULL THEN micros END) AS micros FROM readings)"""
_NORMAL = f"""
{READ}, normal AS (SELECT source_table, row_key, CASE source_table WHEN 'jobs' THEN regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') ELSE regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[+]00:00') END AS standard,
CASE source_table WHEN 'jobs' THEN strftime(day, '%Y-%m-%d') ELSE strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor((micros - floor(micros / 1000000.0) * 1000000) / 1000) AS INT)::VARCHAR, 3, '0') || 'Z' END AS normal_value FROM instants WHERE value IS NOT NULL)"""


@query(f"WITH {_NORMAL} SELECT DISTINCT source_table, row_key, normal_value FROM normal WHERE normal_value IS NOT NULL AND NOT standard")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found(*(read(spark, sf_dir, t) for t in ("jobs", "job_postings", "source_messages", "source_groups")))


@query(f"WITH {_NORMAL} SELECT source_table, count(*) AS readable, count(*) FILTER (standard) AS already_standard FROM normal WHERE normal_value IS NOT NULL GROUP BY 1")
def p4_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: values, values in standard form, readable values."""
    rows = timestamps.normalised_values(*(read(spark, sf_dir, t) for t in ("jobs", "job_postings", "source_messages", "source_groups")))
    return rows.groupBy("source_table").agg(F.count("*").alias("readable"), F.count_if("standard").alias("already_standard"))


QUERIES, ORACLE = query.queries, query.oracle

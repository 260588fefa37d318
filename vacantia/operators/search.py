"""Faceted search: predicates from parameters, one aggregation of provenance, top-k page, total and unfiltered summary."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = {"score": ["-match_score", "-first_seen_at", "-id"], "newest": ["-first_seen_at", "-id"]}
MOST_ROWS = 500


@dataclass(frozen=True)
class SearchParams:
    text: str = ""
    location: str = ""
    technology: str = ""
    sources: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    least_score: float | None = None
    sort: str = "newest"
    limit: int = 200
    buckets: tuple[str, ...] = ()
    allowed_buckets: tuple[str, ...] = ("high_match", "review", "low_match", "rejected")
    snippet: int = 0
    text_columns: tuple[str, ...] = field(default=("title", "company", "location", "description_text"))


def normalised_sources(values: list[str]) -> tuple[str, ...]:
    """The first 50 values, of these the ones of at most 50 characters, folded, each once; blank and ``all`` dropped. The
    bounds are those of the search form: more values, or longer ones, are ignored as there."""
    folded = [v.strip().casefold() for v in values[:50] if len(v) <= 50]
    return tuple(dict.fromkeys(v for v in folded if v and v != "all"))


def requested_buckets(value: str, allowed: tuple[str, ...]) -> tuple[str, ...]:
    """The buckets of a comma-separated value; none for all of them; unknown ones raise."""
    names = tuple(v.strip() for v in value.split(",") if v.strip()) if value.strip() != "all" else ()
    if unknown := [v for v in names if v not in allowed]:
        raise ValueError(f"unknown buckets: {', '.join(unknown)}")
    return names


def contains(column: str, needle: str) -> Column:
    """Case-insensitive substring in which ``%`` and ``_`` are wildcards, as in LIKE; a backslash is itself."""
    return F.lower(F.coalesce(F.col(column), F.lit(""))).like("%" + needle.casefold().replace("\\", "\\\\") + "%")


def predicates(p: SearchParams, columns: list[str]) -> list[Column]:
    out = []
    if p.least_score is not None:
        out.append(F.col("match_score") >= p.least_score)
    if p.buckets:
        out.append(F.col("match_bucket").isin(*requested_buckets(",".join(p.buckets), p.allowed_buckets)))
    if p.text.strip():
        out.append(reduce(Column.__or__, [contains(c, p.text.strip()) for c in p.text_columns if c in columns]))
    if p.location.strip():
        out.append(contains("location", p.location.strip()))
    if p.technology.strip():
        out.append(F.exists("technologies", lambda t: F.lower(t) == p.technology.strip().casefold()))
    if p.statuses and "all" not in p.statuses:
        out.append(F.coalesce("user_status", F.lit("none")).isin(*p.statuses))
    return out


def provenance(postings: DataFrame) -> DataFrame:
    """Per job: number of postings, sources in order, address of the first posting. One pass for three subqueries."""
    return postings.groupBy("job_id").agg(F.count("*").alias("posting_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by("source_message_url", "id").alias("first_message_url"))


def filtered(jobs: DataFrame, postings: DataFrame, p: SearchParams) -> DataFrame:
    rows = jobs
    for condition in predicates(p, jobs.columns):
        rows = rows.filter(condition)
    if p.sources:
        wanted = postings.filter(F.lower("source").isin(*p.sources)).select(F.col("job_id").alias("id"))
        rows = rows.join(wanted, "id", "left_semi")
    return rows


def page(jobs: DataFrame, postings: DataFrame, p: SearchParams) -> DataFrame:
    """The page: the top rows are taken before the provenance is joined, so that only they need it."""
    if p.sort not in SORTS:
        raise ValueError(f"unknown sort {p.sort!r}")
    if not 1 <= p.limit <= MOST_ROWS:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}")
    order = [F.col(c.lstrip("-")).desc() for c in SORTS[p.sort] if c.lstrip("-") in jobs.columns]
    top = filtered(jobs, postings, p).orderBy(*order).limit(p.limit)
    if p.snippet:
        top = top.withColumn("description_text", F.substring("description_text", 1, p.snippet))
    ours = postings.join(top.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return top.join(provenance(ours).withColumnRenamed("job_id", "id"), "id", "left").fillna(0, ["posting_count"]).orderBy(*order)


def total(jobs: DataFrame, postings: DataFrame, p: SearchParams) -> DataFrame:
    return filtered(jobs, postings, p).agg(F.count("*").alias("total"))


def summary(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row with a count for each fixed key, 0 where there is none; filters don't apply."""
    return df.agg(*(F.count_if(F.col(column) == k).alias(k.lower()) for k in keys))


def location_catalogue(jobs: DataFrame, column: str = "location", most: int = 200) -> DataFrame:
    """The most frequent places: counted as written, then by normal form; the label is the smallest spelling."""
    per = jobs.filter(F.trim(F.coalesce(column, F.lit(""))) != "").groupBy(F.trim(column).alias("label")).agg(F.count("*").alias("n"))
    key = F.regexp_replace(F.lower("label"), r"\s+", " ")
    return per.groupBy(key.alias("place")).agg(F.min("label").alias("label"), F.sum("n").alias("jobs")).orderBy(F.desc("jobs"), "place").limit(most)


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in an order that ignores case."""
    return df.filter(F.trim(F.coalesce(column, F.lit(""))) != "").select(F.col(column).alias("value")).distinct().orderBy(F.lower("value"), "value")


def latest_runs(runs: DataFrame, registry: DataFrame, *columns: str) -> DataFrame:
    """Every registered source with its latest run (and more columns of it), ``not_run`` where there is none."""
    held = F.struct("status", *columns)
    last = runs.groupBy(F.lower("source_id").alias("key")).agg(F.max_by(held, "run_id").alias("last"), F.max("run_id").alias("run_id"))
    rows = registry.withColumn("key", F.lower("source_id")).join(last, "key", "left")
    return rows.select(*registry.columns, F.coalesce("last.status", F.lit("not_run")).alias("status"), "run_id", *(F.col(f"last.{c}").alias(c) for c in columns))


def by_company(statuses: DataFrame) -> DataFrame:
    """Statuses in the order of their company, whatever its case, and adapter."""
    return statuses.orderBy(F.lower("company"), "adapter", "source_id")


def refresh_due(statuses: DataFrame, cutoff: Column, enabled: str = "enabled", at: str = "at") -> DataFrame:
    """One row: whether any enabled source has never run, has run at no readable time, or not since the cutoff."""
    when = F.try_to_timestamp(F.col(at).cast("string"))
    return statuses.filter(enabled).agg(F.coalesce(F.bool_or(when.isNull() | (when <= cutoff)), F.lit(False)).alias("due"))


def selected_sources(registry: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The enabled sources, or those of the given ids; an id that isn't registered raises."""
    if wanted is None:
        return registry.filter("enabled")
    ids = sorted({w.casefold() for w in wanted})
    chosen = registry.filter(F.lower("source_id").isin(ids))
    known = {r[0] for r in chosen.select(F.lower("source_id")).distinct().collect()}  # no more than there are ids
    if missing := [i for i in ids if i not in known]:
        raise ValueError(f"unknown sources: {', '.join(missing)}")
    return chosen

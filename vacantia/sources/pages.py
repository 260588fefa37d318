"""Fetched pages: outcome of a fetch, and metadata of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import markup

LEAST_CONTENT = 200


def fetch_outcome(http_status: Column, length: Column, content_type: Column | None = None, prohibited: Column | None = None, resolved: Column | None = None, safe: Column | None = None) -> Column:
    """The outcome of a fetch: whether the source forbids it, its address could be resolved and is safe, then from the
    status, the kind of content (null: markup) and the length of the text taken from it. Tests left out count as passed."""
    no = lambda c: F.coalesce(c, F.lit(False)) == F.lit(False)
    out = F.when(F.coalesce(prohibited, F.lit(False)) if prohibited is not None else F.lit(False), "source_automation_prohibited")
    out = out.when(no(resolved), "source_resolution_error") if resolved is not None else out
    out = out.when(no(safe), "unsafe_url") if safe is not None else out
    out = out.when(http_status.isNull(), "request_error").when(http_status.isin(401, 403, 429), "blocked").when(http_status >= 400, "http_error")
    if content_type is not None:
        kind = F.lower(F.coalesce(content_type, F.lit("")))
        out = out.when(~kind.contains("html") & ~kind.contains("text"), "unsupported_content")
    return out.when(F.coalesce(length, F.lit(0)) < LEAST_CONTENT, "insufficient_content").otherwise("success")


def read_pages(pages: DataFrame, source: str = "html", url: str = "final_url") -> DataFrame:
    """``pages`` with the fields of each page."""
    return pages.withColumn("__p", markup.page(F.col(source), F.col(url))).select("*", "__p.*").drop("__p")


def read_job_pages(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with the fields of each job's own page, and the reason where it can't be used."""
    return pages.withColumn("__p", markup.job_page(source)).select("*", "__p.*").drop("__p")


def usable(job_pages: DataFrame) -> DataFrame:
    """The read job pages; raises at the first one that can't be used."""
    ok = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.col("reason")).cast("boolean"))
    return job_pages.filter(ok).drop("reason")

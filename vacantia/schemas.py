"""Schemas that all sources share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "source string, source_group string, source_message_id string, message_date string, sender string, raw_text string, urls array<string>, source_message_url string"
JOB_FIELDS = ("source", "source_group", "source_message_id", "source_message_url", "message_date", "title", "company", "location", "posted_on", "job_url", "raw_text", "parse_confidence")
JOB = "source string, source_group string, source_message_id string, source_message_url string, message_date string, title string, company string, location string, posted_on string, job_url string, raw_text string, parse_confidence double"


def jobs(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as normalised jobs; fields without a column are null."""
    return df.select(*((columns[c] if c in columns else F.lit(None)).cast("double" if c == "parse_confidence" else "string").alias(c) for c in JOB_FIELDS))


def evolve(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` with the columns it lacks added, with a default where there is one."""
    have = set(df.columns)
    return df.withColumns({c: F.lit((defaults or {}).get(c)).cast(kind) for c, kind in columns.items() if c not in have})

"""Operators over keyed records: first and latest wins, coalescing, occurrence numbers, record assembly, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources whose own address of a vacancy is preferred.
PREFERRED_SOURCES = ("ashby", "greenhouse", "lever", "smartrecruiters", "workable")


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; ties in ``order`` are the caller's to break. The group limit is pushed below the shuffle."""
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)


def top_per_key(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(rank) <= n).drop(rank)


def latest_non_null(df: DataFrame, key: list[str], order: Column, columns: list[str]) -> DataFrame:
    """For each key and column the last value that isn't null; aggregated before the shuffle, not windowed."""
    return df.groupBy(*key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with the rows of ``incoming`` in place of those of equal key; missing columns become null.

    ``incoming`` holds one row a key. A plain table can't be merged in place, so the result is the new table.
    """
    return stored.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def insert_missing(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``incoming`` whose key isn't stored, one a key."""
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def with_tombstones(log: DataFrame, key: list[str], order: list, deleted: Column) -> DataFrame:
    """The state after a log of upserts and deletions: the latest row of each key, unless it deletes."""
    return first_wins(log, key, order).filter(~deleted)


def cascade(children: DataFrame, live: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(live.select(F.col(key).alias(foreign)), foreign, "left_semi")


def monotonic(stored: Column, incoming: Column) -> Column:
    return F.greatest(stored, incoming)


def fill_blank(old: Column, new: Column) -> Column:
    return F.when(F.trim(F.coalesce(old, F.lit(""))) == "", new).otherwise(old)


def cooldown_left(last: Column, least: int, now: Column) -> Column:
    """Seconds until the next run may begin."""
    return F.coalesce(F.greatest(F.lit(0), last + least - now), F.lit(0))


def preferred_url(postings: DataFrame, key: str, url: str, source: str, order: str) -> DataFrame:
    """(key, url): the last address given by a preferred source, else the first address."""
    there = F.coalesce(F.col(url), F.lit("")) != ""
    own = there & F.lower(F.trim(F.col(source))).isin(*PREFERRED_SOURCES)
    return postings.groupBy(key).agg(F.coalesce(F.max_by(url, F.when(own, F.col(order))), F.min_by(url, F.when(there, F.col(order)))).alias("preferred_url"))


def numbered(df: DataFrame, same: list[str], order: list, out: str = "occurrence") -> DataFrame:
    """The number of each row among equal ones."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*same).orderBy(*order)))


def assembled(lines: DataFrame, key: list[str], position: str, line: str, header: Column) -> DataFrame:
    """(key, record_no, body): records that begin at header lines; lines before the first header are left out."""
    flagged = lines.withColumn("record_no", F.sum(header.cast("int")).over(Window.partitionBy(*key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(line).alias("l")))), lambda s: s["l"]), "\n")
    return flagged.filter("record_no > 0").groupBy(*key, "record_no").agg(body.alias("body"))


def nearest_before(key: list[str], position: str, value: Column, reach: int) -> Column:
    """The last value that isn't null in the ``reach`` rows before."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(position).rowsBetween(-reach, -1))


def nearest_after(key: list[str], position: str, value: Column, reach: int) -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(position).rowsBetween(1, reach))


def first_within_days(df: DataFrame, key: list[str], day: Column, ident: str, days: int) -> Column:
    """The smallest id of an earlier row of equal key at most so many days apart, without a join of pairs."""
    near = F.min(ident).over(Window.partitionBy(*key).orderBy(F.datediff(day, F.lit("1970-01-01").cast("date"))).rangeBetween(-days, days))
    return F.when(near < F.col(ident), near)


def import_summary(parsed: DataFrame, stored_keys: DataFrame, key: list[str]) -> DataFrame:
    """Counters of an import: checked, parsed, new and existing postings."""
    marked = parsed.join(stored_keys.select(*key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("checked"), F.count_if(F.col("title").isNotNull()).alias("parsed"), F.count_if(F.col("__there").isNull()).alias("new_postings"), F.count_if("__there").alias("existing_postings"))


def guarded(stored: DataFrame, incoming: DataFrame, key: str, status: str, text: str, replaceable: str) -> DataFrame:
    """``stored`` with summaries put in: where there is no row yet, or the row has the replaceable status and a shorter text.

    ``incoming`` holds one row a key, with the columns of ``stored``."""
    old = stored.select(F.col(key), F.col(status).alias("__s"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("__n"), F.lit(True).alias("__there"))
    wanted = incoming.join(old, key, "left").filter(F.col("__there").isNull() | ((F.col("__s") == replaceable) & (F.col("__n") < F.length(text)))).drop("__s", "__n", "__there")
    return upsert(stored, wanted, [key])


def longest(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, text): the longest text of each key, of equal ones the first."""
    return df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.min_by(text, F.struct((-F.length(text)).alias("a"), F.col(order).alias("b"))).alias(text))


def distinct_terms(df: DataFrame, term: str, normal: Column, order: str) -> DataFrame:
    """The first spelling of each term whose normal form isn't empty."""
    rows = df.withColumn("__n", normal).filter("__n <> ''")
    return rows.groupBy("__n").agg(F.min_by(term, order).alias(term), F.min(order).alias(order)).drop("__n")


def pending(inputs: DataFrame, outputs: DataFrame, key: str, changed: str, done: str) -> DataFrame:
    """The inputs without an output, or changed since their last one; what is polled for is what a run has to do."""
    last = outputs.groupBy(key).agg(F.max(done).alias("__done"))
    return inputs.join(last, key, "left").filter(F.col("__done").isNull() | (F.col(changed) > F.col("__done"))).drop("__done")


MOST_ERROR = 2000


def run_events(runs: DataFrame) -> DataFrame:
    """A run log of appended events (run_id, source_id, at, status, counters, error): each run begins as ``running``; a
    finished one adds an event with its outcome and the first 2,000 characters of its error. Other outcomes raise."""
    begun = runs.select("run_id", "source_id", F.col("started_at").alias("at"), F.lit("running").alias("status"), *(F.lit(0).cast("bigint").alias(c) for c in COUNTERS), F.lit(None).cast("string").alias("error"))
    outcome = F.when(F.col("status").isin("success", "error"), F.col("status")).otherwise(F.raise_error(F.lit("a run ends in success or error")))
    ended = runs.filter("finished_at is not null").select("run_id", "source_id", F.col("finished_at").alias("at"), outcome.alias("status"), *(F.col(c).cast("bigint").alias(c) for c in COUNTERS), F.substring("error", 1, MOST_ERROR).alias("error"))
    return begun.unionByName(ended)


COUNTERS = ("postings_seen", "postings_relevant", "new_jobs", "new_postings")


def run_states(events: DataFrame) -> DataFrame:
    """The last state of each run."""
    order = F.struct((F.col("status") != "running").alias("a"), F.col("at").alias("b"))
    last = F.max_by(F.struct("source_id", "at", "status", *COUNTERS, "error"), order)
    return events.groupBy("run_id").agg(last.alias("s"), F.min("at").alias("started_at")).select("run_id", "started_at", "s.*")


def since(df: DataFrame, column: str, day: Column, strict: bool = True) -> DataFrame:
    """The rows dated on or after a day by the first ten characters; rows without date go. A date that can't be read raises
    if ``strict``, else its row goes too."""
    text = F.col(column)
    read = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    if strict:
        read = F.when(read.isNotNull() | (F.coalesce(text, F.lit("")) == ""), read).otherwise(F.raise_error(F.concat(F.lit("no ISO date: "), text)).cast("date"))
    return df.filter(read >= day)

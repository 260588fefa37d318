"""Identity resolution: postings in order of arrival become jobs.

A posting whose key is known keeps its job; else the job of its URL; else the first job of the same position (title,
company and place), which must be dated within 21 days and, if it has a posting of the same source and group, must not
have another URL; else it becomes a new job. The outcome depends on the order and isn't transitive, so it is replayed.
Postings that share no key, URL, position or fallback key, not even through others, can't affect each other: the
components of these keys are found by spreading the smallest number, and each is replayed in order of arrival. The
replay streams over sorted partitions and remembers the jobs of the current component, never its rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from datetime import date
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.operators.records import PREFERRED_SOURCES
from vacantia.tables import cut_lineage, numbered

NEAR_DAYS = 21
OUTCOME = "arrival_no bigint, first_arrival bigint, new_job boolean, new_posting boolean, job_url string"


def keyed(postings: DataFrame) -> DataFrame:
    """Postings (with ``arrival_no``) with their keys."""
    c = F.col
    return postings.select(
        "arrival_no", "source", "source_group", "posted_on", "job_url",
        F.sha2(F.concat_ws("\u0001", F.coalesce("source", F.lit("")), F.coalesce("source_group", F.lit("")), F.coalesce(c("source_message_id").cast("string"), F.lit(""))), 256).alias("posting_key"),
        t.url_identity(c("job_url")).alias("url_key"),
        t.position_fingerprint(c("title"), c("company"), c("location")).alias("position_key"),
        t.dedupe_key(c("job_url"), c("title"), c("company"), c("location"), c("source"), c("source_group"), c("source_message_id")).alias("fallback_key"),
    )


def identities(jobs: DataFrame) -> DataFrame:
    """(job_id, identity_key, kind): the address key and the position key of each job, where it has them."""
    c = F.col
    keys = F.array(F.struct(t.url_identity(c("job_url")).alias("identity_key"), F.lit("url").alias("kind")), F.struct(t.position_fingerprint(c("title"), c("company"), c("location")).alias("identity_key"), F.lit("position").alias("kind")))
    return jobs.select(c("id").alias("job_id"), F.explode(keys).alias("k")).select("job_id", "k.*").filter("identity_key is not null")


def by_address(postings: DataFrame, known: DataFrame) -> DataFrame:
    """``postings`` with the first job of their address, of those that have one."""
    first = known.filter("kind = 'url'").groupBy("identity_key").agg(F.min("job_id").alias("job_id"))
    return postings.withColumn("identity_key", t.url_identity(F.col("job_url"))).join(first, "identity_key").drop("identity_key")


def by_position(postings: DataFrame, jobs: DataFrame, key: list[str], days: int = NEAR_DAYS) -> DataFrame:
    """(key, job_id): the first job of a posting's position that is dated at most so many days apart.

    Time is cut into spans as long as the days within reach. Each (position, day) has one first job, which stands in the
    two spans from which it can be reached (rarely one), and a posting asks in its own span only, so postings aren't
    multiplied. Both sides grow with the input and are estimated far too low (generated rows and decompression don't count),
    so neither may be broadcast."""
    c, width = F.col, 2 * days + 1
    span = lambda n: F.floor(n / width)
    place = t.position_fingerprint(c("title"), c("company"), c("location"))
    first = jobs.select(place.alias("k"), t.date_part(c("posted_on")).alias("day"), c("id")).filter("k is not null and day is not null")
    first = first.withColumn("span", F.explode(F.sequence(span(F.unix_date("day") - days), span(F.unix_date("day") + days)))).groupBy("k", "span", "day").agg(F.min("id").alias("id"))
    asked = postings.select(*key, place.alias("k"), t.date_part(c("posted_on")).alias("posted")).filter("k is not null and posted is not null").withColumn("span", span(F.unix_date("posted")))
    return asked.join(first.hint("merge"), ["k", "span"]).filter(F.abs(F.datediff("posted", "day")) <= days).groupBy(*key).agg(F.min("id").alias("job_id"))


def components(rows: DataFrame, keys: tuple[str, ...] = ("posting_key", "url_key", "position_key", "fallback_key"), most_rounds: int = 60) -> DataFrame:
    """(arrival_no, component): the smallest arrival number reachable over shared keys."""
    links = cut_lineage(rows.select("arrival_no", F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(k), F.lit(":"), F.col(k))) for k in keys])).alias("k")).filter("k is not null").distinct())
    labels = rows.select("arrival_no", F.col("arrival_no").alias("component")).distinct()
    for _ in range(most_rounds):
        by_key = links.join(labels, "arrival_no").groupBy("k").agg(F.min("component").alias("low"))
        lower = links.join(by_key, "k").groupBy("arrival_no").agg(F.min("low").alias("low"))
        new = labels.join(lower, "arrival_no", "left").select("arrival_no", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("old"))
        # Follow the label of the label as well: chains shrink by powers of two.
        hop = new.select(F.col("arrival_no").alias("component"), F.col("component").alias("far"))
        new = cut_lineage(new.join(hop, "component", "left").select("arrival_no", F.least("component", F.coalesce("far", "component")).alias("component"), "old"))
        changed = new.filter("component <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text[:10]) if text else None
    except ValueError:
        return None


class Position:
    """The jobs of one position: the first of all, and by day, so that only days within reach are looked at."""

    def __init__(self) -> None:
        self.jobs: list[int] = []
        self.days: list[int] = []
        self.at: dict[int, list[int]] = {}

    def add(self, job: int, day: date | None) -> None:
        insort(self.jobs, job)
        self.move(job, None, day)

    def move(self, job: int, old: date | None, new: date | None) -> None:
        if old is not None:
            self.at[old.toordinal()].remove(job)
        if new is not None:
            n = new.toordinal()
            if n not in self.at:
                self.at[n] = []
                insort(self.days, n)
            insort(self.at[n], job)

    def near(self, day: date) -> list[list[int]]:
        """Ascending lists of the jobs of each day within reach."""
        n = day.toordinal()
        return [self.at[k] for k in self.days[bisect_left(self.days, n - NEAR_DAYS) : bisect_right(self.days, n + NEAR_DAYS)] if self.at[k]]


class Replay:
    """The jobs of one component."""

    def __init__(self) -> None:
        self.postings: dict[str, int] = {}
        self.urls: dict[str, int] = {}
        self.positions: dict[str, Position] = {}
        self.jobs: dict[int, dict] = {}

    def add(self, r) -> tuple[int, bool, bool]:
        known = self.postings.get(r.posting_key)
        job, new = known, False
        if job is None:
            job = self.urls.get(r.url_key) if r.url_key else None
            if job is None:
                job = self.at_position(r)
            if job is None:
                job, new = int(r.arrival_no), True
                self.jobs[job] = {"url": r.job_url, "url_key": r.url_key, "day": _day(r.posted_on), "groups": set(), "positions": set()}
        state = self.jobs[job]
        if not new:
            if r.job_url and (not state["url"] or (r.source or "").strip().casefold() in PREFERRED_SOURCES):
                state["url"], state["url_key"] = r.job_url, r.url_key
            if r.posted_on and (day := _day(r.posted_on)) != state["day"]:
                for key in state["positions"]:
                    self.positions[key].move(job, state["day"], day)
                state["day"] = day
        if r.url_key:
            self.urls.setdefault(r.url_key, job)
        if r.position_key and r.position_key not in state["positions"]:
            self.positions.setdefault(r.position_key, Position()).add(job, state["day"])
            state["positions"].add(r.position_key)
        if known is None:
            self.postings[r.posting_key] = job
            state["groups"].add(((r.source or "").lower(), (r.source_group or "").lower()))
        return job, new, known is None

    def at_position(self, r) -> int | None:
        place = self.positions.get(r.position_key) if r.position_key else None
        if place is None:
            return None
        if not r.url_key:
            return place.jobs[0]
        day = _day(r.posted_on)
        if day is None:
            return None
        group = ((r.source or "").lower(), (r.source_group or "").lower())
        # Another requisition of the same feed has another address; such jobs are passed over.
        for job in merge(*place.near(day)):
            state = self.jobs[job]
            if group in state["groups"] and state["url_key"] and state["url_key"] != r.url_key:
                continue
            return job
        return None


def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, state = None, Replay()
    for pdf in frames:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        rows = []
        for r in pdf.itertuples(index=False):
            if r.component != current:
                current, state = r.component, Replay()
            job, new, new_posting = state.add(r)
            rows.append((int(r.arrival_no), job, new, new_posting, state.jobs[job]["url"]))
        yield pd.DataFrame(rows, columns=["arrival_no", "first_arrival", "new_job", "new_posting", "job_url"])


def resolved(postings: DataFrame, first_id: int = 1) -> DataFrame:
    """(arrival_no, job_id, new_job, new_posting): job ids count from ``first_id`` in order of first arrival."""
    rows = cut_lineage(keyed(postings))
    ordered = rows.join(components(rows), "arrival_no").repartition("component").sortWithinPartitions("component", "arrival_no")
    out = cut_lineage(ordered.mapInPandas(replay, OUTCOME))
    ids = numbered(out.filter("new_job").select("first_arrival"), F.col("first_arrival"), out="n").select("first_arrival", (F.col("n") + first_id).alias("job_id"))
    return out.join(ids, "first_arrival").select("arrival_no", "job_id", "new_job", "new_posting")

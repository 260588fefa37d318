"""Best representative of each duplicate group, by currency reasoning.

Trusted choice: the posting of the most trusted source, then of the highest confidence, then the latest, then the
smallest id. Current choice: the latest posting by its own timestamp. The order of values without a readable timestamp is
reasoned, beside dated values of the group too: ``learn_precedence`` counts, over all groups with timestamps, how often
one value of a field is directly followed by another; a value precedes another if it does so more often than the
reverse, and ``reachable`` follows these arcs to the end. ``latest_values`` puts the undated values of each group into
one partial order with the dated ones and returns its latest value.

Defined results: a group without postings, or whose jobs are unknown, keeps its row with zeros and null values; null
confidence and unreadable timestamps come last; a source without trust rank comes after all ranked ones; ties end at the
smallest id; repeated rows change nothing; empty tables give an empty result. Other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.timestamps import with_parsed
from vacantia.tables import cut_lineage

#: Titles that name no role, after trimming and lower-casing.
PLACEHOLDER_TITLES = ("", "-", "--", "?", "??", "???", "n/a", "na", "none", "null", "nil", "tbd", "tba", "untitled", "no title", "(no title)", "job", "open role", "position", "vacancy", "title", "test", "unknown", "undefined", "new position", "open position", "job title", "to be defined", "x", "xx", "xxx", ".", "...", "…")

UNRANKED = 2**31 - 1
LAST = 2**63 - 1


def names_role(title: Column) -> Column:
    """Whether a title names a role: it has a letter and isn't a placeholder. Null counts as no."""
    text = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return text.rlike(r"\p{L}{2}") & ~text.isin(*PLACEHOLDER_TITLES)


def group_rows(groups: DataFrame, jobs: DataFrame, postings: DataFrame, trust: DataFrame, chat_groups: DataFrame) -> DataFrame:
    """One row for each posting of a grouped job, with its instant and its rank; one with nulls for a job without any."""
    zones = chat_groups.select("source_group", "tz_name", "date_order").dropDuplicates(["source_group"])
    ranks = trust.groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    posts = postings.select(F.col("id").alias("posting_id"), "job_id", "source", "source_group", "message_date", "parse_confidence")
    members = groups.select("group_id", "job_id").distinct()
    rows = members.join(posts, "job_id", "left").join(jobs.select(F.col("id").alias("job_id"), "title").dropDuplicates(["job_id"]), "job_id", "left")
    rows = rows.join(zones, "source_group", "left").join(ranks, "source", "left")
    rows = with_parsed(rows, F.col("message_date"), "message_day", "instant", F.col("tz_name"), F.col("date_order"))
    confidence = F.when(F.isnan("parse_confidence"), None).otherwise(F.col("parse_confidence"))
    order = F.struct(F.coalesce("trust_rank", F.lit(UNRANKED)).alias("a"), F.coalesce(-confidence, F.lit(float("inf"))).alias("b"), F.coalesce(-F.col("instant"), F.lit(LAST)).alias("c"), F.col("posting_id").alias("d"))
    return rows.select("group_id", "job_id", "posting_id", "source", "title", "parse_confidence", "instant", order.alias("preference"))


def survivors(rows: DataFrame) -> DataFrame:
    """The choices of each group; partial minima are taken before the shuffle, so that no group meets in one task whole."""
    exists = F.col("posting_id").isNotNull()
    titled = F.when(exists & names_role(F.col("title")), F.struct(F.col("preference").alias("a"), F.col("job_id").alias("b")))
    current = F.when(exists & F.col("instant").isNotNull(), F.struct((-F.col("instant")).alias("a"), F.col("posting_id").alias("b")))
    return rows.groupBy("group_id").agg(
        F.coalesce(F.min(titled)["b"], F.lit(0)).alias("title_job_id"),
        F.coalesce(F.min(F.when(exists, F.col("preference")))["d"], F.lit(0)).alias("source_posting_id"),
        F.coalesce(F.min(current)["b"], F.lit(0)).alias("latest_posting_id"),
    )


def learn_precedence(rows: DataFrame, field: str, least: int = 2) -> DataFrame:
    """(earlier, later, votes): direct transitions between values of ``field`` in each group, in the order in which the
    timestamped rows show them first, kept where they are seen at least ``least`` times and more often than the reverse."""
    known = rows.filter(F.col("instant").isNotNull() & F.col(field).isNotNull())
    # The rows of a group shrink to its distinct values before the shuffle; only these are put in order in one task.
    known = known.groupBy("group_id", F.col(field).alias("value")).agg(F.min("instant").alias("since"))
    steps = known.withColumn("before", F.lag("value").over(Window.partitionBy("group_id").orderBy("since", "value")))
    steps = steps.filter("before <> value").groupBy(F.col("before").alias("earlier"), F.col("value").alias("later")).agg(F.count("*").alias("votes"))
    back = steps.select(F.col("later").alias("earlier"), F.col("earlier").alias("later"), F.col("votes").alias("against"))
    kept = steps.join(back, ["earlier", "later"], "left").filter((F.col("votes") >= least) & (F.col("votes") > F.coalesce("against", F.lit(0))))
    return kept.select("earlier", "later", "votes")


def reachable(precedence: DataFrame, starts: DataFrame) -> DataFrame:
    """(earlier, later): every value that a path of learned arcs leads to from a value of ``starts``, to the end."""
    arcs = cut_lineage(precedence.select("earlier", "later"))
    step = cut_lineage(arcs.join(starts.select(F.col("value").alias("earlier")).distinct(), "earlier", "left_semi"))
    known = step
    while not step.isEmpty():
        further = step.join(arcs.select(F.col("earlier").alias("later"), F.col("later").alias("next")), "later").select("earlier", F.col("next").alias("later")).distinct()
        step = cut_lineage(further.join(known, ["earlier", "later"], "left_anti"))
        known = cut_lineage(known.unionByName(step))
    return known


def latest_values(rows: DataFrame, field: str, precedence: DataFrame) -> DataFrame:
    """(group_id, value, reasoned): the topologically latest value of each group, null if there is none.

    The order of a group: its values with readable timestamps follow each other by their latest one; a value without any
    precedes or follows another where the learned arcs lead from one to the other, over whatever values (if they lead both
    ways, neither precedes). An undated value replaces the latest dated one only if it follows that one and precedes no
    dated value; so of values that can't be compared the dated one is taken, else the smallest."""
    stamp = F.when(F.col("instant").isNotNull(), F.struct((-F.col("instant")).alias("a"), F.col("posting_id").alias("b")))
    values = rows.filter(F.col(field).isNotNull()).groupBy("group_id", F.col(field).alias("value")).agg(F.min(stamp).alias("stamp"))
    values = cut_lineage(values)  # read four times below
    dated = values.filter("stamp is not null").groupBy("group_id").agg(F.min(F.struct("stamp", "value"))["value"].alias("top"))
    held = values.join(values.filter("stamp is null").select("group_id").distinct(), "group_id", "left_semi").join(dated, "group_id", "left")
    held = cut_lineage(held.select("group_id", "value", F.col("stamp").isNotNull().alias("dated"), "top"))
    free = held.filter("not dated")
    starts = held.filter("not dated or value = top")
    # A value is compared along the learned paths only, never with every other value of its group.
    paths = starts.select("group_id", F.col("value").alias("earlier"), F.col("dated").alias("from_dated")).join(reachable(precedence, starts), "earlier")
    arcs = paths.join(held.select("group_id", F.col("value").alias("later"), F.col("dated").alias("to_dated")), ["group_id", "later"])
    arcs = cut_lineage(arcs.filter("earlier <> later and not (from_dated and to_dated)"))
    above = arcs.filter("from_dated").select("group_id", F.col("later").alias("value"))
    below = arcs.filter("to_dated").select("group_id", F.col("earlier").alias("value"))
    newer = free.filter("top is not null").join(above, ["group_id", "value"], "left_semi").join(below, ["group_id", "value"], "left_anti")
    open_values = free.filter("top is null").unionByName(newer).select("group_id", "value")
    back = arcs.select("group_id", F.col("later").alias("earlier"), F.col("earlier").alias("later"))
    strict = arcs.filter("not from_dated and not to_dated").join(back, ["group_id", "earlier", "later"], "left_anti")
    beaten = strict.join(open_values.withColumnRenamed("value", "later"), ["group_id", "later"], "left_semi").select("group_id", F.col("earlier").alias("value"))
    last = open_values.join(beaten, ["group_id", "value"], "left_anti").groupBy("group_id").agg(F.min("value").alias("last"))
    out = rows.select("group_id").distinct().join(dated, "group_id", "left").join(last, "group_id", "left")
    return out.select("group_id", F.coalesce("last", "top").alias("value"), F.when(F.coalesce("last", "top").isNotNull(), F.col("last").isNotNull()).alias("reasoned"))


def fused(rows: DataFrame) -> DataFrame:
    """The whole surviving record: the trusted and current choices, and the current source and title of each group."""
    rows = cut_lineage(rows)  # read seven times below
    out = survivors(rows)
    for field in ("source", "title"):
        role = rows.filter(names_role(F.col("title"))) if field == "title" else rows
        values = latest_values(role, field, learn_precedence(role, field)).select("group_id", F.col("value").alias(f"current_{field}"), F.col("reasoned").alias(f"{field}_reasoned"))
        out = out.join(values, "group_id", "left")
    return out

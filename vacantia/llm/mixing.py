"""Mixing sources to target weights along a time-varying curriculum.

The mix is as large as the corpus. Each source's demand is its target share of it, at most ``max_repeats`` times its own
tokens; what capped sources can't give goes to the others in proportion to their targets. The weight of a source runs
linearly over training time, from (as far as no weight becomes negative) the share it has in the corpus towards the other
side of its mean, so that the weights sum to one at all times and integrate to the demand. A copy of a text begins at a
cumulative number of tokens of its source; inverting the integral of the weight gives the time, and so the position, at
which the mix has used so many. The mix is then range-sorted by position.

Cumulative tokens are summed in two levels, over hash buckets of each source and within a bucket, so that a source with
a third of all texts is still summed in many tasks. Only the totals of the sources in ``mix_targets`` reach the driver.

Defined results: texts without tokens, of a null source or of a source without target aren't used; a target without
texts gets none, and its share goes to the others; if all sources are capped, the mix is smaller than the corpus;
texts whose copy begins before the demand is met are used, so a source exceeds its demand by less than one text;
repeated rows are separate texts; empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.packing import sizes
from vacantia.llm.tokenizer import VOCABULARY
from vacantia.tables import cut_lineage

#: Texts of a source whose tokens are summed in one task; the number of hash buckets follows the number of texts.
BUCKET_ROWS = 50_000
MAX_SOURCES = 10_000
PLAN = "source string, target_share double, corpus_share double, corpus_tokens bigint, demand double, most int, slope double, mean double, total double"


def demands(rows: list[tuple[str, float, int, int]], total: float) -> dict[str, float]:
    """Tokens each source shall give: (source, share, most repeats, own tokens) filled up to the caps."""
    cap = {s: max(0, most) * own for s, _, most, own in rows}
    share = {s: max(0.0, w) for s, w, _, _ in rows}
    out = dict.fromkeys(share, 0.0)
    open_sources, left = {s for s in share if share[s] > 0 and cap[s] > 0}, total
    while open_sources and left > 1e-9:
        weight = sum(share[s] for s in open_sources)
        full = {s for s in open_sources if left * share[s] / weight >= cap[s]}
        if not full:
            for s in open_sources:
                out[s] = left * share[s] / weight
            break
        for s in full:
            out[s] = float(cap[s])
        left -= sum(cap[s] for s in full)
        open_sources -= full
    return out


def plan(texts: DataFrame, targets: DataFrame) -> list[tuple]:
    """Demand and weight schedule of each source with a target."""
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources with a target")
    # No more rows than there are targets, which have just been counted.
    own = {r.source: r.t for r in texts.join(targets.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = float(texts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    want = demands([(r.source, r.w or 0.0, r.m or 0, own.get(r.source, 0)) for r in rows], total)
    size, held = sum(want.values()) or 1.0, sum(own.values()) or 1.0
    gap = {r.source: own.get(r.source, 0) / held - want[r.source] / size for r in rows}
    steep = min([1.0] + [want[s] / size / abs(g) for s, g in gap.items() if abs(g) > 1e-12 and want[s] > 0])
    return [(r.source, float(r.w or 0), own.get(r.source, 0) / total if total else 0.0, int(own.get(r.source, 0)), want[r.source], int(r.m or 0), (steep * gap[r.source] if want[r.source] > 0 else 0.0), want[r.source] / size, size) for r in rows]


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (position, source, doc_id, copy_no, pass_no, tokens), sorted by position, and its plan."""
    spark = documents.sparkSession
    texts = cut_lineage(sizes(documents, vocabulary))
    schedule = spark.createDataFrame(plan(texts, targets), PLAN)
    buckets = max(16, -(-texts.count() // BUCKET_ROWS))
    keyed = texts.join(targets.select("source").distinct(), "source", "left_semi").withColumn("h", F.xxhash64("doc_id", "copy_no", F.lit("mix"))).withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = keyed.groupBy("source", "b").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "b", (F.sum("t").over(Window.partitionBy("source").orderBy("b")) - F.col("t")).alias("ahead"))
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id", "copy_no")
    placed = keyed.withColumn("within", F.sum("tokens").over(inside) - F.col("tokens")).join(before, ["source", "b"]).join(schedule, "source")
    copies = placed.withColumn("pass_no", F.explode(F.expr("sequence(0L, greatest(0L, cast(ceil(demand / greatest(corpus_tokens, 1L)) as bigint)))")))
    copies = copies.withColumn("start", F.col("pass_no") * F.col("corpus_tokens") + F.col("ahead") + F.col("within")).filter("start < demand and pass_no < most")
    # weight(t) = mean + slope (1 - 2 t); its integral (mean + slope) t - slope t^2 is the share of the mix used up to t.
    y = (F.col("start") + F.col("tokens") / 2) / F.col("total")
    b = F.col("mean") + F.col("slope")
    t = 2 * y / (b + F.sqrt(F.greatest(b * b - 4 * F.col("slope") * y, F.lit(0.0))))
    out = copies.select(F.floor(F.least(t, F.lit(1.0)) * F.col("total")).cast("bigint").alias("position"), "source", "doc_id", "copy_no", "pass_no", "tokens")
    return out.orderBy("position", "source", "doc_id", "copy_no", "pass_no"), schedule


def shares(mix: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per source: target, share in the corpus, actual share of the mix, tokens, most passes used."""
    per = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("pass_no").alias("passes"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = schedule.join(per, "source", "left")
    return rows.select("source", "target_share", F.round("corpus_share", 6).alias("corpus_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.round(F.col("tokens") / F.lit(max(1, total)), 6), F.lit(0.0)).alias("actual_share"), F.coalesce(F.col("passes") + 1, F.lit(0)).alias("passes_used"), F.col("most").alias("max_repeats"))

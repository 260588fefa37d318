"""Filling containers of fixed capacity with texts: hierarchical residual packing.

Texts are cut only where they exceed the capacity, into pieces of the capacity and a rest. Pieces are spread over
partitions by hash. Each partition packs its pieces by decreasing best fit; containers that are full to ``NEARLY`` are
final. The others become the items of the next round, spread anew over as many partitions as ``PER_PARTITION`` items
each ask for, and are packed again as wholes. A round that merges less than ``LEAST_MERGED`` of its containers ends the
packing of that kind, as does one of a single partition: what is then open (items of 60 % of the capacity never fit
together) is final as it is. So no task ever holds more than about ``PER_PARTITION`` items, and no rounds are wasted.

A round moves items and containers as numbers; pieces stay apart and learn their container by a join of the open ones.

Defined results: null texts and texts without tokens take no space and get no row; a text of exactly the capacity fills
a container; equal sizes are packed in the order of doc_id and piece; repeated rows are separate texts (``copy_no``
tells rows of one doc_id apart); capacities below one token raise; two capacities of one kind are packed apart; empty
tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.tokenizer import VOCABULARY, token_counter
from vacantia.tables import cut_lineage, spread

NEARLY = 0.985
PER_PARTITION = 20_000
LEAST_MERGED = 0.02
MAX_KINDS = 1000
MADE = "kind_no int, capacity bigint, item bigint, label string, filled bigint"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each container, by decreasing best fit; open containers are kept by the space they have left."""
    bins: list[list[int]] = []
    left: dict[int, list[int]] = {}
    mask = 0  # bit k: some container has k left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        rest = room - size
        if rest:
            left.setdefault(rest, []).append(b)
            mask |= 1 << rest
    return bins


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copy_no, tokens) of all texts with tokens."""
    counted = spread(documents.filter(F.col("text").isNotNull()).select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", token_counter(vocabulary)("text").alias("tokens"))
    numbered = cut_lineage(counted.filter("tokens > 0"))
    return numbered.withColumn("copy_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("tokens", "source")).cast("bigint") - 1)


def _pack(round_no: int):
    """Items of one partition to containers: one row an item, with the label and the fill of its container."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "item"], kind="stable", ignore_index=True)
        size, item = pdf["size"].to_numpy(), pdf["item"].to_numpy()
        bins = best_fit(size.tolist(), int(key[1]))
        at = np.fromiter((i for b in bins for i in b), np.int64, len(size))
        count = np.fromiter(map(len, bins), np.int64, len(bins))
        filled = np.add.reduceat(size[at], np.cumsum(count) - count)
        labels = np.array([f"{round_no}-{key[0]}-{key[2]}-{n}" for n in range(len(bins))], dtype=object)
        return pd.DataFrame({"kind_no": key[0], "capacity": key[1], "item": item[at], "label": np.repeat(labels, count), "filled": np.repeat(filled, count)})

    return pack


def _packed_items(items: DataFrame, counts: dict[int, int], round_no: int) -> DataFrame:
    """A round over (kind_no, capacity, item, order, size), in as many partitions a kind as its items ask for."""
    parts = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, -(-n // PER_PARTITION))]), F.col("kind_no"))
    spread_items = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(round_no)), parts.cast("bigint")))
    return cut_lineage(spread_items.groupBy("kind_no", "capacity", "part").applyInPandas(_pack(round_no), MADE))


def packed(documents: DataFrame, pack_sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, copy_no, piece_no, tokens): one row a piece."""
    if pack_sizes.filter("capacity_tokens is null or capacity_tokens < 1").limit(1).count():
        raise ValueError("a capacity is below one token")
    kinds = pack_sizes.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    return _packed(sizes(documents, vocabulary), kinds)


def _packed(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    pieces = cut_lineage(_pieces(texts, kinds).withColumn("item", F.monotonically_increasing_id()))
    whole = pieces.filter("tokens = capacity").withColumn("container_id", F.format_string("w-%020d-%d-%010d", "doc_id", "copy_no", "piece_no"))
    rest = pieces.filter("tokens < capacity")
    counts = {r.kind_no: r.n for r in rest.groupBy("kind_no").agg(F.count("*").alias("n")).collect()}  # at most MAX_KINDS rows
    done, round_no, bins = [], 0, None
    order = F.format_string("%020d-%d-%010d", "doc_id", "copy_no", "piece_no")
    items = rest.select("kind_no", "capacity", "item", order.alias("order"), F.col("tokens").alias("size"))
    while counts:
        made = _packed_items(items, counts, round_no)
        # The pieces of open containers carry the number of their container, which is the item of the next round.
        bins = made if bins is None else bins.join(made.select(F.col("item").alias("bin"), F.col("label").alias("l"), F.col("filled").alias("f")), "bin").select("kind_no", "capacity", "item", F.col("l").alias("label"), F.col("f").alias("filled"))
        bins = cut_lineage(bins) if round_no else bins
        closed = F.col("filled") >= F.ceil(NEARLY * F.col("capacity"))
        per = made.groupBy("kind_no").agg(F.count_distinct("label").alias("made"), F.count_distinct(F.when(~closed, F.col("label"))).alias("open")).collect()
        ends = {r.kind_no for r in per if not r.open or -(-counts[r.kind_no] // PER_PARTITION) == 1 or round_no and counts[r.kind_no] - r.made < LEAST_MERGED * counts[r.kind_no]}
        final = closed | F.col("kind_no").isin(*ends) if ends else closed
        done.append(bins.filter(final).select("item", F.col("label").alias("container_id")))
        counts = {r.kind_no: r.open for r in per if r.kind_no not in ends}
        left = bins.filter(~final)
        heads = cut_lineage(left.groupBy("kind_no", "capacity", "label", "filled").agg(F.min("item").alias("bin")))
        bins = left.select("item", "label").join(heads.select("label", "bin", "kind_no", "capacity"), "label").select("kind_no", "capacity", "item", "bin")
        items = heads.select("kind_no", "capacity", F.col("bin").alias("item"), F.col("label").alias("order"), F.col("filled").alias("size"))
        round_no += 1
    columns = ("container_kind", "container_id", "doc_id", "copy_no", "piece_no", "tokens")
    out = whole.select(*columns)
    if done:
        places = done[0]
        for d in done[1:]:
            places = places.unionByName(d)
        out = out.unionByName(rest.join(places, "item").select(*columns))
    return out


def _pieces(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every text once for each kind of container, cut where it exceeds the capacity. The kinds are few (checked), and
    each text is written once for each: they are an array in every row, not a join."""
    rows = [(r.container_kind, r.capacity) for r in kinds.limit(MAX_KINDS + 1).collect()]
    if len(rows) > MAX_KINDS:
        raise ValueError(f"over {MAX_KINDS} kinds of containers")
    if not rows:
        return texts.limit(0).select(F.lit("").alias("container_kind"), F.lit(0).alias("kind_no"), F.lit(1).cast("bigint").alias("capacity"), "doc_id", "copy_no", F.lit(0).cast("bigint").alias("piece_no"), "tokens")
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    each = texts.withColumn("k", F.explode(F.array(*[F.struct(F.lit(k).cast("string").alias("container_kind"), F.lit(n).alias("kind_no"), F.lit(c).cast("bigint").alias("capacity")) for n, (k, c) in enumerate(rows)])))
    each = each.select("doc_id", "copy_no", F.col("tokens").alias("all_tokens"), "k.container_kind", "k.kind_no", "k.capacity")
    each = each.withColumn("piece_no", F.explode(F.expr("sequence(0L, (all_tokens - 1) div capacity)")))
    return each.select("container_kind", "kind_no", "capacity", "doc_id", "copy_no", "piece_no", F.least(F.col("capacity"), F.col("all_tokens") - F.col("piece_no") * F.col("capacity")).alias("tokens"))


def report(rows: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the least number of containers possible, share of space used."""
    per = rows.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    kinds = pack_sizes.select("container_kind", "capacity_tokens").distinct()
    return kinds.join(per, "container_kind", "left").select(
        "container_kind", "capacity_tokens", F.coalesce("containers", F.lit(0)).alias("containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce("tokens", F.lit(0)) / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used_share"),
    )

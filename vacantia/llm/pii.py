"""Personal information inside free text: found by a character-level BiLSTM-CRF, replaced by typed placeholders.

A text is written in symbols (``pii_net.shape``), cut into windows at line and sentence ends, and windows over ``WIDTH``
characters into overlapping ones, whose emissions are blended with weights that fall towards their borders before one
CRF decoding of the whole stretch, so that spans across the cuts agree. Windows that read alike in symbols are decoded
once in a worker process; the memory of decoded windows is bounded and only saves time. A check of the exact form then
settles the borders of each span (``pii_text.settle``).

The work is one narrow pass of an Arrow function: no shuffle, and nothing depends on the neighbouring rows.

Defined results: null texts give null (no rows), empty and blank texts no spans; texts of any length are read whole;
spans are ordered and never overlap; repeated rows stay repeated until ``found`` takes distinct rows; other columns are
kept. Placeholders are ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.tables import spread

from vacantia.llm import pii_net as net
from vacantia.llm.pii_text import STRIDE, WIDTH, pieces, settle

SPANS = T.ArrayType(T.StructType([T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()), T.StructField("pii_type", T.StringType())]))
KEEP_WINDOWS = 400_000


class Finder:
    """Finds spans in texts; holds the network and the windows decoded so far."""

    def __init__(self, model: dict[str, np.ndarray] | None = None) -> None:
        self.net = net.Decoder(model or net.load())
        self.known: dict[str, list[tuple[int, int, str]]] = {}

    def decode(self, windows: list[str]) -> None:
        """Puts the spans of new windows into the memory."""
        short = sorted((w for w in windows if len(w) <= WIDTH), key=len)
        for k in range(0, len(short), 512):
            part = short[k : k + 512]
            x, lengths = net.codes(part)
            tags = self.net.tags(x, lengths)
            some = tags.any(1)
            for r, w in enumerate(part):
                self.known[w] = net.spans(tags[r, : lengths[r]]) if some[r] else []
        for w in windows:
            if len(w) > WIDTH:
                self.known[w] = self.decode_long(w)

    def decode_long(self, window: str) -> list[tuple[int, int, str]]:
        """Overlapping windows, blended, then one decoding of the whole stretch."""
        n = len(window)
        starts = list(range(0, n - WIDTH, STRIDE)) + [n - WIDTH]
        total, weight = np.zeros((n, net.K), np.float32), np.zeros(n, np.float32)
        ramp = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)
        for k in range(0, len(starts), 256):
            part = starts[k : k + 256]
            e = self.net.emissions(*net.codes([window[s : s + WIDTH] for s in part]))
            for r, s in enumerate(part):
                total[s : s + WIDTH] += e[r] * ramp[:, None]
                weight[s : s + WIDTH] += ramp
        total /= weight[:, None]
        return net.spans(net.viterbi(self.net.m, total[None], np.array([n]))[0])

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]] | None]:
        """For each text its spans, counted from 0, the end not included."""
        if len(self.known) > KEEP_WINDOWS:
            self.known.clear()
        cut = [None if t is None else pieces(net.shape(t), t) for t in texts]
        self.decode(list({w for c in cut if c for _, w in c if w not in self.known}))
        out: list[list[tuple[int, int, str]] | None] = []
        for t, c in zip(texts, cut):
            if c is None:
                out.append(None)
                continue
            got: list[tuple[int, int, str]] = []
            for at, w in c:
                for a, b, kind in self.known[w]:
                    if (exact := settle(t, at + a, at + b, kind)) and (not got or exact[0] >= got[-1][1]):
                        if kind == "name" and got and got[-1][2] == "name" and t[got[-1][1] : exact[0]] == ", ":
                            exact = (got.pop()[0], exact[1])  # family name first
                        got.append((*exact, kind))
            out.append(got)
        return out


_finder: Finder | None = None


def finder() -> Finder:
    """The finder of this process."""
    global _finder
    if _finder is None:
        _finder = Finder()
    return _finder


@F.pandas_udf(SPANS)
def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The spans of each text; positions count characters from 1, both ends included."""
    for s in batches:
        found = finder().find([t if isinstance(t, str) else None for t in s])
        yield pd.Series([None if f is None else [{"start_pos": a + 1, "end_pos": b, "pii_type": k} for a, b, k in f] for f in found])


@F.pandas_udf(T.StringType())
def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each text with its personal information replaced by placeholders, the rest unchanged."""
    for s in batches:
        texts = [t if isinstance(t, str) else None for t in s]
        out = []
        for t, f in zip(texts, finder().find(texts)):
            if t is not None:
                parts, at = [], 0
                for a, b, k in f:
                    parts += [t[at:a], f"[{k.upper()}]"]
                    at = b
                t = "".join(parts) + t[at:]
            out.append(t)
        yield pd.Series(out, dtype=object)


def texts(postings: DataFrame, messages: DataFrame) -> DataFrame:
    """(source_table, row_key, text) of both tables."""
    key: Column = F.concat("source_group", F.lit("/"), "source_message_id")
    return postings.select(F.lit("job_postings").alias("source_table"), F.col("id").cast("string").alias("row_key"), F.col("raw_text").alias("text")).unionByName(
        messages.select(F.lit("source_messages").alias("source_table"), key.alias("row_key"), F.col("sender").alias("text"))
    )


def found(postings: DataFrame, messages: DataFrame) -> DataFrame:
    """p2_found: distinct items of personal information."""
    rows = spread(texts(postings, messages).filter(F.col("text").isNotNull()), "row_key").select("source_table", "row_key", F.explode(spans("text")).alias("s"))
    return rows.select("source_table", "row_key", "s.start_pos", "s.end_pos", "s.pii_type").distinct()

"""Page boilerplate mixed with main content.

A page is rendered to its visible lines (``layout``), each with the line of the source it stands on. Rendering alone
shows all visible text, so it cannot tell the vacancy from the menus around it. Each rendered line is therefore judged by
a small network (numpy, fitted by ``boilerplate_train`` on a bounded sample) from

- its layout: length, punctuation, bullets, separators, capitals, distance to both ends of the page, and in pages with
  markup whether it stands in the frame of the page or is mostly links;
- its frequency: the share of all pages that show the line, and how near to the ends of the pages it stands there;
- its words and word pairs, hashed;
- the same of the ``REACH`` lines before and after it.

The counts of lines cover all pages. Only lines on more than one page of ``RARE`` are sent to the workers: at most
``RARE`` times the mean number of lines of a page, however many pages there are (and the number is checked).

Defined results: null, empty and blank texts have no lines; lines are counted from 1 with blank ones; a line that is
furniture in one page and vacancy text in another (a role as title) is judged by its neighbours; repeated rows give the
same lines again; texts of any length are read whole; other columns are kept.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from importlib.resources import files
from itertools import chain
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm import residue
from vacantia.llm.layout import MARKUP, render_blocks
from vacantia.tables import spread

MODEL = Path(__file__).with_name("boilerplate_model.npz")
SLOTS, DIMS, HIDDEN, REACH = 8192, 6, 24, 4
#: A line counts as frequent on more than one of so many pages.
RARE = 2000
MOST_FREQUENT = 4_000_000
#: Lines from either end of a page beyond which it doesn't matter how far they are.
FAR = 40
WIDTH = (2 * REACH + 1) * DIMS + 3 * 4 + 5


def line_number(line: str) -> int:
    """The same 64-bit number of a line in every process; 0 stands for the number of pages."""
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def line_counts(pages: Iterable[list[str]]) -> list[pd.DataFrame]:
    """(k, n, top, bottom): on how many pages each line stands and the sums of its first places, of the solid lines of pages."""
    number: dict[str, int] = {}
    pages = list(pages)
    code = np.array([number.setdefault(x, len(number)) for p in pages for x in p], np.int64)
    size = np.fromiter(map(len, pages), np.int64, len(pages))
    page, start = np.repeat(np.arange(len(pages)), size), np.repeat(np.cumsum(size) - size, size)
    # The first of equal lines of a page counts.
    first = np.unique(page * max(1, len(number)) + code, return_index=True)[1]
    place = np.arange(len(code)) - start
    of, top, bottom = code[first], np.minimum(place, FAR)[first], np.minimum(np.repeat(size, size) - 1 - place, FAR)[first]
    count = lambda w=None: np.bincount(of, w, minlength=len(number))
    return [pd.DataFrame({"k": np.fromiter(map(line_number, number), np.int64, len(number)), "n": count().astype(np.int64), "top": count(top), "bottom": count(bottom)})]


def frequent(rows: Iterable[tuple], pages: int) -> dict[int, tuple[float, float, float, float]]:
    """The features of frequent lines: (k, n, top, bottom) to share, and mean places. One page doesn't make a line frequent."""
    return {k: (1.0, 1 + math.log10((n - 1) / pages) / 4, top / n / FAR, bottom / n / FAR) for k, n, top, bottom in rows if (n - 1) * RARE > pages}


class _Slots(dict):
    """Word to its slot, filled on demand; bounded, and only saves time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = "".join("0" if c.isdigit() else c for c in word.casefold().strip(".,;:!?()[]\"'…"))
        out = self[word] = crc32(plain.encode("utf-8", "surrogatepass")) % SLOTS
        return out


_slots = _Slots()


_SEPARATOR, _DIGIT = re.compile(r"[|·/>›»•©–—]"), re.compile(r"\d")
#: How many slots each feature of the layout has; they stand behind those of the words.
SHAPES = (13, 13, 64, 64, 5, 5, 2, 2)
SHAPE_AT = SLOTS + np.cumsum((0, *SHAPES[:-1]))
ALL_SLOTS = SLOTS + sum(SHAPES)


def features(line: str) -> tuple[list[int], tuple[int, ...]]:
    """Slots of the words of a line, and its layout: words, length, last and first character, share of capitals,
    separators, sign of copyright, digits."""
    words = line.split()
    slots = [_slots[w] for w in words]
    size, first, last = len(slots), line[0], line[-1]
    capitals = sum([w[0].isupper() for w in words])
    marks = len(_SEPARATOR.findall(line)) if _SEPARATOR.search(line) else 0
    e = 0 if last.isalpha() else 1 if last.isdigit() else 2 + ord(last) % 62
    s = 0 if first.isupper() else 1 if first.isalpha() else 2 if first.isdigit() else 3 + ord(first) % 61
    return slots, (min(size, 12), min(len(line) // 12, 12), e, s, 4 * capitals // size, min(marks, 4), int("©" in line), int(_DIGIT.search(line) is not None))


class Rows:
    """The solid lines of many pages: distinct ones with their features, and the place of each."""

    def __init__(self, pages: list[list[str]], marks: list[list[bool] | None], table: dict[int, tuple]) -> None:
        number: dict[str, int] = {}
        self.code = np.array([number.setdefault(x, len(number)) for p in pages for x in p], np.int64)
        size = np.fromiter(map(len, pages), np.int64, len(pages))
        self.page = np.repeat(np.arange(len(pages)), size)
        self.place = np.arange(len(self.code)) - np.repeat(np.cumsum(size) - size, size)
        self.size = np.repeat(size, size)
        self.marked = np.concatenate([np.full(n, -1.0) if m is None else np.asarray(m, float) for n, m in zip(size, marks)]) if len(pages) else np.zeros(0)
        unique = [features(x) for x in number]
        self.words = [w for w, _ in unique]
        self.shape = np.array([x for _, x in unique], np.int64).reshape(len(unique), len(SHAPES)) + SHAPE_AT
        none = (0.0, 0.0, 0.0, 0.0)
        self.often = np.array([table.get(line_number(x), none) for x in number] if table else [none] * len(number), np.float32).reshape(len(number), 4)


def own(m: dict[str, np.ndarray], rows: Rows, keep_words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vector of each distinct line: the scaled sum of the slots of its words, word pairs, first and last word, and
    layout; besides the slots, their number and the scale of each line."""
    n = len(rows.words)
    words = rows.words if keep_words is None else [w if k else [] for w, k in zip(rows.words, keep_words)]
    size = np.fromiter(map(len, words), np.int64, n)
    flat = np.fromiter(chain.from_iterable(words), np.int64, int(size.sum()))
    line = np.repeat(np.arange(n), size)
    pairs = np.flatnonzero(line[1:] == line[:-1])
    both = (flat[pairs] * 31 + flat[pairs + 1] * 17 + 7) % SLOTS
    some, end = np.flatnonzero(size), np.cumsum(size)
    first, last = (flat[(end - size)[some]] * 5 + 3) % SLOTS, (flat[end[some] - 1] * 11 + 5) % SLOTS
    slots = np.concatenate([flat, both, first, last, rows.shape.ravel()])
    of = np.concatenate([line, line[pairs], some, some, np.repeat(np.arange(n), len(SHAPES))])
    order = np.argsort(of, kind="stable")
    slots, count = slots[order], np.bincount(of, minlength=n)
    # Long lines count as their mean, so that no length drowns the rest.
    scale = (1 / np.maximum(np.sqrt(np.maximum(count, 1)), count / 12)).astype(np.float32)
    total = np.add.reduceat(m["T"][slots], np.cumsum(count) - count, axis=0) if n else np.zeros((0, DIMS), np.float32)
    return total * scale[:, None], slots, count, scale


def inputs(rows: Rows, vectors: np.ndarray) -> np.ndarray:
    """What the network sees of each line."""
    n = len(rows.code)
    x = np.zeros((n, WIDTH), np.float32)
    for k, o in enumerate(range(-REACH, REACH + 1)):
        low, high = max(0, -o), max(0, -o, min(n, n - o))
        same = rows.page[low:high] == rows.page[low + o : high + o]
        x[low:high, k * DIMS : (k + 1) * DIMS] = vectors[rows.code[low + o : high + o]] * same[:, None]
    base = (2 * REACH + 1) * DIMS
    for k, o in enumerate((-1, 0, 1)):
        low, high = max(0, -o), max(0, -o, min(n, n - o))
        same = rows.page[low:high] == rows.page[low + o : high + o]
        x[low:high, base + 4 * k : base + 4 * k + 4] = rows.often[rows.code[low + o : high + o]] * same[:, None]
    x[:, -5] = np.minimum(rows.place, FAR) / FAR
    x[:, -4] = np.minimum(rows.size - 1 - rows.place, FAR) / FAR
    x[:, -3] = rows.place == 0
    x[:, -2] = rows.marked == 1
    x[:, -1] = rows.marked == 0
    return x


def decide(m: dict[str, np.ndarray], rows: Rows, keep_words: np.ndarray | None = None) -> np.ndarray:
    """Whether each line isn't vacancy."""
    if not len(rows.code):
        return np.zeros(0, bool)
    x = inputs(rows, own(m, rows, keep_words)[0])
    return np.tanh(x @ m["W"] + m["b"]) @ m["v"] + m["c"][0] > 0


_model: dict[str, np.ndarray] = {}


def model() -> dict[str, np.ndarray]:
    """The network of this process; the package may be an archive."""
    if not _model:
        with np.load(io.BytesIO(files(__package__).joinpath(MODEL.name).read_bytes())) as z:
            _model.update({k: z[k].astype(np.float32) for k in z.files})
    return _model


#: Lines that are judged at once; bounds the memory of a task.
AT_ONCE = 120_000


def outside_of(sources: list[str | None], table: dict[int, tuple]) -> list[list[int] | None]:
    """For each page the numbers of the source lines that aren't vacancy."""
    out: list[list[int]] = []
    group: list[tuple[list[tuple[int, str]], list[bool] | None]] = []

    def judge() -> None:
        pages, marks, numbers = [], [], []
        for lines, frame in group:
            solid = [k for k, (_, x) in enumerate(lines) if x and not x.isspace()]
            pages.append([lines[k][1].strip() for k in solid])
            numbers.append([lines[k][0] for k in solid])
            marks.append(None if frame is None else [frame[k] for k in solid])
        hit, at = decide(model(), Rows(pages, marks, table)), 0
        for n in numbers:
            out.append(sorted({x for x, h in zip(n, hit[at : at + len(n)]) if h}))
            at += len(n)
        group.clear()

    size = 0
    for source in sources:
        group.append(([], None) if source is None else render_blocks(source))
        size += len(group[-1][0])
        if size > AT_ONCE:
            judge()
            size = 0
    judge()
    return [None if source is None else lines for source, lines in zip(sources, out)]


def outside(source: str, table: dict[int, tuple] | None = None) -> list[int]:
    """The source lines of a page that aren't vacancy."""
    return outside_of([source], table or {})[0]


def solid_lines(source: str) -> list[str]:
    """The visible lines of a page that aren't blank, without the blanks around them."""
    lines = source.split("\n") if not MARKUP.search(source) else [x for _, x in render_blocks(source)[0]]
    return [s for x in lines if (s := x.strip())]


STATISTICS = "t string, k bigint, n bigint, top double, bottom double"


def statistics(details: DataFrame) -> tuple[dict[int, tuple[float, float, float, float]], dict[str, int]]:
    """The features of the frequent lines of all pages (see the module for their number) and the counts of the tokens of
    the exemplars of ``residue``, from one pass over the texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pages = [solid_lines(x) for x in rows["description_text"] if isinstance(x, str)]
            yield line_counts(pages)[0].assign(t=None)[["t", "k", "n", "top", "bottom"]]
            tokens = residue.window_counts(rows["page_title"], rows["description_text"])
            yield pd.DataFrame({"t": list(tokens), "k": 0, "n": list(tokens.values()), "top": 0.0, "bottom": 0.0})

    rows = spread(details.select("job_id", "page_title", "description_text"), "job_id").select("page_title", "description_text")
    counted = rows.mapInPandas(count, STATISTICS).groupBy("k", "t").agg(F.sum("n").alias("n"), F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    pages = details.filter(F.col("description_text").isNotNull()).count()
    kept = counted.filter(F.col("t").isNotNull() | ((F.col("n") - 1) * RARE > pages)).limit(MOST_FREQUENT + 1).collect()
    if len(kept) > MOST_FREQUENT:
        raise ValueError(f"over {MOST_FREQUENT} frequent lines: the pages have over {MOST_FREQUENT // RARE} lines on average")
    return frequent([(r.k, r.n, r.top, r.bottom) for r in kept if r.t is None], pages), {r.t: r.n for r in kept if r.t is not None}


def outside_lines(table: dict[int, tuple]):
    """A column function: the source lines of each page that aren't vacancy."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(outside_of([t if isinstance(t, str) else None for t in s], table))

    return lines


def main_body(table: dict[int, tuple]):
    """A column function: each rendered page without the lines that aren't vacancy."""

    @F.pandas_udf(T.StringType())
    def body(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            sources = [t if isinstance(t, str) else None for t in s]
            out = []
            for source, drop in zip(sources, outside_of(sources, table)):
                gone = set(drop or ())
                out.append(None if source is None else "\n".join(text for number, text in render_blocks(source)[0] if number not in gone).strip("\n"))
            yield pd.Series(out, dtype=object)

    return body


def found(details: DataFrame, is_residue=None) -> DataFrame:
    """p3_found: (job_id, line_no) of the lines that aren't vacancy; pages that ``is_residue``, a column function over title
    and text (by default that of ``residue``), marks are left out in the same pass, so that no text is shuffled."""
    table, count = statistics(details)
    is_residue = is_residue or residue.marker(details, residue.Judge(*residue.weights(count)))
    pages = spread(details.select("job_id", "page_title", "description_text").filter(F.col("description_text").isNotNull()), "job_id").filter(~is_residue("page_title", "description_text"))
    return pages.select("job_id", F.explode(outside_lines(table)("description_text")).alias("line_no")).distinct()

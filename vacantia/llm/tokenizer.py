"""Sizes in tokens of a public tokenizer.

The vocabulary file is read once on the driver (its size is checked) and travels with the function; every worker process
builds the tokenizer once. Null texts have null tokens, empty ones none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public vocabulary whose tokens are counted; a parameter of every operator that counts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_BYTES = 8_000_000
# Fixed value: the published pattern that this vocabulary's texts are split with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_built: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tokenizer of a vocabulary, once a process."""
    key = hash(ranks)
    if key not in _built:
        import tiktoken

        _built[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _built[key]


def token_counter(path: str = VOCABULARY):
    """A column function: text to its number of tokens."""
    ranks = Path(path).read_bytes()
    if len(ranks) > MAX_BYTES:
        raise ValueError(f"{path} has over {MAX_BYTES} bytes")

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(ranks)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if isinstance(t, str) else None for t in s], dtype="Int64")

    return count

"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import spread

#: Ranks file of the tokenizer, on every executor; and the pattern that splits text before the merges (fixed value).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(ranks: str = RANKS):
    """The tokenizer of a ranks file, loaded once in a process."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_counts(df: DataFrame, text: str, carry: list[Column], ranks: str = RANKS) -> DataFrame:
    """The carried columns and n_tokens, the size of the whole text; null and empty texts have 0."""
    picked = spread(df.select(*carry, F.col(text).alias("__text")))
    schema = picked.drop("__text").schema.simpleString()[7:-1].replace(":", " ") + ", n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(ranks).encode_ordinary
        for pdf in batches:
            sizes = [len(encode(t)) if t else 0 for t in pdf["__text"]]
            yield pdf.drop(columns="__text").assign(n_tokens=sizes)

    return picked.mapInPandas(run, schema)

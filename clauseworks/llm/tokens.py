"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level vocabulary, and the split pattern such vocabularies are used with.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file; built once in a worker."""
    import tiktoken

    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; null and empty texts have none. Whole texts are counted, in Arrow batches."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def sized(df: DataFrame, id_col: str, text_col: str, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """(id, *keep, n_tokens), each id once."""
    rows = df.select(F.col(id_col), *keep, token_count(F.col(text_col), path).alias("n_tokens"))
    return rows.groupBy(id_col).agg(*[F.max(c).alias(c) for c in (*keep, "n_tokens")])

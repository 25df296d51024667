"""Token counts of whole texts by a public tokenizer; its file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-pair tokenizers of this kind split text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, columns: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``columns`` of ``df`` plus ``n_tokens``; null text has 0 tokens.  The text itself goes no further."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            counts = [len(encode(t)) if t else 0 for t in pdf["_text"]]
            yield pdf[columns].assign(n_tokens=counts)

    return df.select(*columns, F.col(text).alias("_text")).mapInPandas(run, f"{schema}, n_tokens long")

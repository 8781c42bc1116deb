"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _encoding(path: str):  # noqa: ANN202
    """The encoding of a vocabulary file; a Python worker reads it once, whatever the number of its tasks. Functions reach
    workers by value, so what a worker keeps is kept on ``sys``."""
    import tiktoken

    kept = sys.__dict__.setdefault("_cairnset_encodings", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_count(text: Column, path: str = DEFAULT_RANKS) -> Column:
    """Number of tokens of a text (null: null). ``path``: a vocabulary file, readable on all executors."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for s in batches:
            yield s.map(lambda t: None if t is None else len(enc.encode_ordinary(t))).astype("Int64")

    return count(text)


def sized_texts(documents: DataFrame, path: str = DEFAULT_RANKS, extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens`` and the ``extra`` columns of documents whose text is not null or empty."""
    return documents.where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), *extra, token_count(F.col("text"), path).alias("n_tokens"))

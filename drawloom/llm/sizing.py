"""Sizes of texts in tokens of a public tokenizer, and source names."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawloom.llm.storage import busy

#: Rank file of a byte-level vocabulary; every worker must find it here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts were split before merging (a fixed value of that vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, once a worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """documents without text but with its number of tokens; null and empty texts have 0. Whole texts are counted."""
    others = [c for c in documents.columns if c not in (text, tokens)]
    narrow = busy(documents.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`")))

    def run(batches):
        count = encoding(vocabulary).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = np.array([len(count(t)) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], names=[*others, tokens])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema][:-1]).add(tokens, T.LongType()))


def source_key(column: str | Column) -> Column:
    """Source names alike but for case, outer blanks or trailing slashes; null for null and blank ones."""
    c = F.col(column) if isinstance(column, str) else column
    name = F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[/\s]+$", ""))
    return F.when(name != "", name)

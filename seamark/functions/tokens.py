"""Token counts with the vocabulary files of public tokenizers; the path is a parameter and the files are never copied."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from seamark.functions.worker import resource

#: Where the vocabulary files lie; every operator takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY):
    """The encoder of this process; special tokens in a text are ordinary text."""

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}
        return tiktoken.Encoding("seamark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return resource(("tokens", path), make)


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids of a whole text."""
    return encoder(path).encode_ordinary(text)


def count_tokens(c: Column, path: str = VOCABULARY) -> Column:
    """Tokens of each text, null for null; Arrow batches, one encoder for each worker."""

    @pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else len(encode(t, path))).astype("Int64")

    return count(c)

"""Token counts of texts by a public tokenizer, whose folder is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

FOLDER = os.environ.get("DISPATCHLINE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's authors part text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(folder: str = FOLDER, ranks: str = RANKS):
    """The tokenizer of one vocabulary file."""
    import tiktoken

    with open(os.path.join(folder, ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def with_tokens(documents: DataFrame, keep: str = "doc_id bigint", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """The kept columns and n_tokens of the whole text; null and empty texts have 0 tokens."""
    names = [c.strip().split(" ")[0] for c in keep.split(",")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]
            yield pdf[names].assign(n_tokens=pd.Series(n, pdf.index, "int64"))

    return spread(documents).select(*names, documents[text_col].alias("_text")).mapInPandas(count, f"{keep}, n_tokens bigint")

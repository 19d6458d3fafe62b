"""Tokens of whole texts by a vocabulary, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encode = Callable[[list[str]], list[list[int]]]


def byte_bpe(path: str | None = None) -> Encode:
    """The encoder of a ``tokenizers`` file, of a public byte-level vocabulary unless one is named."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def tokenize(rows: DataFrame, key: str, text: str, limit: int | None = 512, encoder: Callable[[], Encode] = byte_bpe) -> DataFrame:
    """(key, input_ids, attention_mask, seq_len): whole texts are encoded, then cut to ``limit`` tokens; null is empty."""
    rows = rows.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        encode = encoder()
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                ids = [np.array(x[:limit], dtype=np.int32) for x in encode([t or "" for t in part[text]])]
                masks = [np.ones(len(x), dtype=np.int32) for x in ids]
                yield pd.DataFrame({key: part[key].to_numpy(), "input_ids": ids, "attention_mask": masks, "seq_len": [len(x) for x in ids]})

    return rows.mapInPandas(run, f"`{key}` {kind}, input_ids array<int>, attention_mask array<int>, seq_len int")

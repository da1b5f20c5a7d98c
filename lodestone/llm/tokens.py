"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Vocabulary in ranks; a parameter of everything that counts tokens.
VOCABULARY = os.environ.get("TOKENIZER_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How text is cut before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, path: str) -> str | None:
    """Send the vocabulary to the executors, which need not have it; the name it has there. None where the driver has no such file."""
    if not os.path.isfile(path):
        return None
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _counter(path: str, name: str | None, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or encoder(SparkFiles.get(name) if name else path)
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text_at).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns) if i != text_at] + [pa.array(sizes, pa.int64())]
            names = [n for i, n in enumerate(b.schema.names) if i != text_at] + ["tokens"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def with_tokens(df: DataFrame, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """df without its text but with `tokens`, its length; null and empty texts have 0. A column named tokens is replaced."""
    df = df.drop(*[c for c in ("tokens",) if c in df.columns and c != text_col])
    at = df.columns.index(text_col)
    keep = [f for i, f in enumerate(df.schema.fields) if i != at]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["tokens long"])
    return df.mapInArrow(_counter(path, shipped(df.sparkSession, path), at), schema)

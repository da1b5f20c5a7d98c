"""Connectors to models: embedders, rerankers, judges. Each is a function of a batch; the defaults need no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def __call__(self, query: str, docs: list[str]) -> list[float]: ...


def hash_embedder(dim: int = 64) -> Embedder:
    """Unit vectors from hashed words: equal texts have equal vectors, and shared words bring texts near."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def overlap_reranker(query: str, docs: list[str]) -> list[float]:
    """The share of the query's words that a document holds."""
    q = set(query.lower().split())
    return [len(q & set(d.lower().split())) / len(q) if q else 0.0 for d in docs]


def retried(call: Callable, attempts: int = 4, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after failures that carry retry_after or a status of 429 or 5xx, with doubling waits."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                status = getattr(e, "status", None)
                if n + 1 == attempts or status is None or not (status == 429 or 500 <= status < 600):
                    raise
                sleep(getattr(e, "retry_after", None) or first_wait * 2**n)
        raise AssertionError

    return run


def with_embeddings(df: DataFrame, text_col: str, out_col: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """df with a vector for each text, in batches of Arrow rows; null text has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out_col) + f", `{out_col}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop(columns=[out_col], errors="ignore")
            out: list = [None] * len(b)
            at = [i for i, t in enumerate(b[text_col]) if t is not None]
            for s in range(0, len(at), batch):
                part = at[s : s + batch]
                for i, v in zip(part, embedder([b[text_col].iloc[i] for i in part])):
                    out[i] = v
            yield b.assign(**{out_col: pd.Series(out, index=b.index, dtype=object)})

    return df.mapInPandas(run, schema)


def budget_batches(sizes: list[int], budget: int, most: int) -> list[list[int]]:
    """Consecutive items in requests of at most `budget` size and `most` items; an item over the budget goes alone."""
    out: list[list[int]] = []
    total = 0
    for i, s in enumerate(sizes):
        if not out or total + s > budget or len(out[-1]) == most:
            out.append([])
            total = 0
        out[-1].append(i)
        total += s
    return out

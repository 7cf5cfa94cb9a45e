"""Interfaces to models that live elsewhere, with deterministic stand-ins: embedders and answer givers. Answers are kept in a table by a digest of the request."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Unit vectors of hashed words and character trigrams; no model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            low = f" {t.lower()} "
            for g in [*low.split(), *(low[j : j + 3] for j in range(len(low) - 2))]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embed(texts: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 16) -> DataFrame:
    """(key, embedding): batches of batch texts go to the embedder; null texts have null vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                v = embedder([t or "" for t in part[text]])
                yield pd.DataFrame({key: part[key], "embedding": [None if t is None else x.tolist() for t, x in zip(part[text], v)]})

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<double>")


def answer(requests: DataFrame, key: str, prompt: str, ask: Callable[[str], str], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, answer), rows to add to the cache): prompts known by their digest are read from cache (digest, answer); each other distinct prompt is asked once."""
    r = requests.select(key, prompt, F.sha2(F.col(prompt), 256).alias("digest"))
    asked = r.select("digest", prompt).dropDuplicates(["digest"])
    if cache is not None:
        asked = asked.join(cache.select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"digest": b.digest, "answer": [ask(p) for p in b[prompt]]})

    fresh = asked.filter(F.col(prompt).isNotNull()).mapInPandas(run, "digest string, answer string")
    known = fresh if cache is None else fresh.unionByName(cache.select("digest", "answer"))
    return r.join(known, "digest", "left").select(key, "answer"), fresh

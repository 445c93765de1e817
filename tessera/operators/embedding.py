"""Embedding (K1): a protocol for models, batching with recursive splits and retries, and two embedders.

A remote model is called from the tasks, in requests of at most ``max_texts`` texts and ``max_tokens``
estimated tokens. Ids follow from the text's place, so a task that is run again overwrites its own rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunking import BATCH_TEXTS, BATCH_TOKENS

DOCUMENT_RETRIES, DOCUMENT_DELAY = 5, 1.0
QUERY_RETRIES, QUERY_DELAY = 2, 0.5


class TooManyTokens(RuntimeError):
    """The model refuses a request for its length; the batch is halved."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic unit vectors from hashed words, for tests and where no model is at hand."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for word in t.lower().split():
                h = int.from_bytes(hashlib.sha256(word.encode("utf-8")).digest()[:8], "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class Precomputed:
    """Vectors that a table already holds, by text."""

    def __init__(self, vectors: dict[str, list[float]]):
        self.vectors = vectors
        self.dimension = len(next(iter(vectors.values()), []))

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.vectors[t] for t in texts]


def requests(texts: list[str], max_texts: int = BATCH_TEXTS, max_tokens: int = BATCH_TOKENS) -> list[list[str]]:
    out: list[list[str]] = [[]]
    held = 0
    for t in texts:
        cost = len(t) // 4
        if out[-1] and (len(out[-1]) >= max_texts or held + cost > max_tokens):
            out.append([])
            held = 0
        out[-1].append(t)
        held += cost
    return [x for x in out if x]


def call(model: Embedder, texts: list[str], retries: int = DOCUMENT_RETRIES, delay: float = DOCUMENT_DELAY, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One request with backoff; a batch that is too long is halved until single texts remain."""
    for attempt in range(retries):
        try:
            return model.embed(texts)
        except TooManyTokens:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return call(model, texts[:half], retries, delay, sleep) + call(model, texts[half:], retries, delay, sleep)
        except (ConnectionError, TimeoutError):
            if attempt + 1 == retries:
                raise
            sleep(delay * 2**attempt * (1 + random.random() / 4))
    return []


def embed_query(model: Embedder, query: str) -> list[float]:
    return call(model, [query], QUERY_RETRIES, QUERY_DELAY)[0]


def embed_chunks(chunks: DataFrame, model: Embedder, max_texts: int = BATCH_TEXTS, max_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``chunks`` with ``vector`` in the same row: texts and vectors never meet by position of two frames."""
    names = [c for c in chunks.columns if c != "vector"]
    packed = chunks.select(F.struct(*names).alias("row"), F.col("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vectors = [v for part in requests(texts, max_texts, max_tokens) for v in call(model, part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["row", "vector"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, vector array<float>")
    return out.select("row.*", "vector")

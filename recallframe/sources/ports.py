"""Pluggable models, and the dense pipeline's checks around them."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.functions.text import trim_space


class Unavailable(RuntimeError):
    """The embedder doesn't answer, or not as the space says."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic embedder for tests: signed word hashes, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word in text.lower().split() or [""]:
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                v[h % self.dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else np.eye(1, self.dimension)[0]).astype("float32").tolist())
        return out


def space_id(provider: str, model: str, dimension: int, document_version: str, query_version: str, fingerprint: str) -> str:
    """The identity of an embedding space: a hash over its length-prefixed fields, the dimension as eight bytes."""
    parts = [provider, model, document_version, query_version, fingerprint]
    if dimension < 1 or not all(p.strip() for p in parts):
        raise ValueError("every part is required and the dimension is positive")
    framed = lambda s: struct.pack(">Q", len(s.encode())) + s.encode()
    data = framed("embedding-space-v1") + framed(provider) + framed(model) + struct.pack(">Q", dimension) + b"".join(map(framed, parts[2:]))
    return "space_v1_" + hashlib.sha256(data).hexdigest()


def vector_sha256(vector: list[float]) -> str:
    return hashlib.sha256(np.asarray(vector, ">f4").tobytes()).hexdigest()


def embed_frame(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 128, probe: str | None = None, fingerprint: str | None = None) -> DataFrame:
    """``df`` with vectors of its texts, asked for in batches inside the tasks.

    With a ``probe``, each call embeds it too, and its vector must have the
    ``fingerprint``: so every vector comes from the very model that was checked.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    dimension, ahead = embedder.dimension, [] if probe is None else [probe]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list = []
            for at in range(0, len(pdf), batch):
                texts = pdf[text].fillna("").tolist()[at : at + batch]
                got = embedder.embed([*ahead, *texts])
                if len(got) != len(ahead) + len(texts):
                    raise Unavailable(f"{len(got)} vectors for {len(ahead) + len(texts)} texts")
                for v in got:
                    if len(v) != dimension or not np.isfinite(v).all() or not np.any(v):
                        raise Unavailable("an invalid vector")
                if ahead and vector_sha256(got[0]) != fingerprint:
                    raise Unavailable("the embedder changed")
                vectors += got[len(ahead) :]
            yield pdf.assign(**{out: vectors})

    return df.mapInPandas(work, schema)


@dataclass(frozen=True)
class Space:
    """What an embedding space's id stands for, all but its probe's fingerprint."""

    provider: str
    model: str
    dimension: int
    document_version: str
    query_version: str

    def id(self, fingerprint: str) -> str:
        return space_id(self.provider, self.model, self.dimension, self.document_version, self.query_version, fingerprint)


def ready(embedder: Embedder, probe: str, space: Space, expected_space: str) -> str:
    """The probe's fingerprint, provided that two calls agree on it and it gives the expected space."""
    if embedder.dimension != space.dimension:
        raise Unavailable(f"{embedder.dimension} dimensions, not {space.dimension}")
    first, second = (vector_sha256(embedder.embed([probe])[0]) for _ in range(2))
    if first != second or space.id(first) != expected_space:
        raise Unavailable("the embedder is not the one of the space")
    return first


def dense_search(queries: DataFrame, embedder: Embedder, probe: str, expected_space: str, space: Space, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embeds trimmed queries and searches; the embedder is checked before, and again with each batch of queries. Blank queries find nothing."""
    fingerprint = ready(embedder, probe, space, expected_space)
    asked = queries.withColumn("__text", trim_space(F.col("text"))).where("__text <> ''")
    return search(embed_frame(asked, "__text", embedder, "vector", probe=probe, fingerprint=fingerprint).drop("__text"))

"""Embedding providers and cache-first embedding."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterable, Sequence
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity
from ..functions.scoring import MAX_DIMENSIONS

_TOKEN = re.compile(r"[^\W_]+")
# letters that don't fold to letters: a text that holds one is folded token by token
_UNLIKE = re.compile("[" + "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if c != c.casefold() and (_TOKEN.fullmatch(c) is None or _TOKEN.fullmatch(c.casefold()) is None)) + "]")


class TransientError(RuntimeError):
    """A provider's failure that may pass: it is tried again."""


@runtime_checkable
class Provider(Protocol):
    model_id: str
    params_hash: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class HashProvider:
    """Signed feature hashing of words and adjacent pairs, of unit length: offline and deterministic."""

    def __init__(self, dimensions: int = 256, model: str | None = None, namespace: str = identity.NAMESPACE) -> None:
        if type(dimensions) is not int or not 0 < dimensions <= MAX_DIMENSIONS:
            raise ValueError(f"dimensions must be 1 ... {MAX_DIMENSIONS}")
        self.dimensions, self.model = dimensions, model or f"{namespace}-hash-{dimensions}-v1"
        if not self.model.strip():
            raise ValueError("a model needs a name")
        self.person = f"{namespace}-hash-v1".encode()[:16]
        self.model_id, self.params_hash = identity.embedding_identity("hash", self.model, dimensions, namespace=namespace)
        self._memo: dict[str, int] = {}

    def _hashed(self, features: Iterable[str]) -> np.ndarray:
        """Twice the place of each feature, and 1 more where its sign is positive."""
        digest, person = hashlib.blake2b, self.person
        raw = np.frombuffer(b"".join([digest(f, digest_size=16, person=person).digest() for f in map(str.encode, features)]), "<u8").reshape(-1, 2)
        return (raw[:, 0] % np.uint64(self.dimensions)).astype(np.int64) * 2 + (raw[:, 1] & np.uint64(1)).astype(np.int64)

    def _known(self, tokens: list[str]) -> np.ndarray:
        """The same; of single words some 500,000 are kept, while most pairs don't come again soon enough to be worth it."""
        new = list(set(tokens).difference(self._memo))
        if len(self._memo) + len(new) > 500_000:
            self._memo.clear()
            new = list(set(tokens))
        self._memo.update(zip(new, self._hashed(new).tolist()))
        return np.array(list(map(self._memo.__getitem__, tokens)), np.int64)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.matrix(texts).tolist()

    def matrix(self, texts: Sequence[str]) -> np.ndarray:
        """A row of unit length for each text, zeros for one without a word."""
        words: list[str] = []
        pairs: list[str] = []
        count = []
        for text in texts:
            tokens = [t.casefold() for t in _TOKEN.findall(text)] if _UNLIKE.search(text) else _TOKEN.findall(text.casefold())
            words += tokens
            pairs += map("\x1f".join, zip(tokens, tokens[1:]))
            count.append(len(tokens))
        n = len(count)
        if not words:
            return np.zeros((n, self.dimensions))
        code = np.concatenate([self._known(words), self._hashed(pairs)])
        row = np.concatenate([np.repeat(np.arange(n), count), np.repeat(np.arange(n), np.maximum(0, np.array(count) - 1))])
        out = np.bincount(row * self.dimensions + (code >> 1), 2.0 * (code & 1) - 1, minlength=n * self.dimensions).reshape(n, self.dimensions)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


class OpenAIProvider:
    """Batches to an embeddings endpoint; needs the ``openai`` package and a key in the environment of the executors."""

    def __init__(self, model: str, dimensions: int, base_url: str | None = None, namespace: str = identity.NAMESPACE) -> None:
        self.model, self.dimensions, self.base_url = model, dimensions, base_url
        self.model_id, self.params_hash = identity.embedding_identity("openai", model, dimensions, base_url, namespace)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        try:
            import openai
        except ImportError as e:
            raise RuntimeError("install the openai package to use this provider") from e
        try:
            answer = openai.OpenAI(base_url=self.base_url, max_retries=0).embeddings.create(model=self.model, input=list(texts), dimensions=self.dimensions)
        except openai.APIConnectionError as e:
            raise TransientError(str(e)) from e
        except openai.APIStatusError as e:
            raise (TransientError if e.status_code in (408, 409, 429) or e.status_code >= 500 else RuntimeError)(str(e)) from e
        found = {d.index: d.embedding for d in answer.data}
        if sorted(found) != list(range(len(texts))):
            raise RuntimeError("the provider's answer doesn't match its input")
        return [found[i] for i in range(len(texts))]


class SentenceTransformersProvider:
    """A local model; needs the ``sentence-transformers`` package on the executors."""

    def __init__(self, model: str, dimensions: int, namespace: str = identity.NAMESPACE) -> None:
        self.model, self.dimensions, self._loaded = model, dimensions, None
        self.model_id, self.params_hash = identity.embedding_identity("sentence-transformers", model, dimensions, namespace=namespace)

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if self._loaded is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError("install sentence-transformers to use this provider") from e
            self._loaded = SentenceTransformer(self.model)
            if self._loaded.get_sentence_embedding_dimension() != self.dimensions:
                raise RuntimeError("the model has other dimensions than configured")
        return self._loaded.encode(list(texts), normalize_embeddings=True).tolist()


def create_provider(provider: str, model: str | None = None, dimensions: int = 256, base_url: str | None = None) -> Provider:
    if provider == "hash":
        return HashProvider(dimensions, model)
    if provider == "openai":
        return OpenAIProvider(model or "", dimensions, base_url)
    if provider == "sentence-transformers":
        return SentenceTransformersProvider(model or "", dimensions)
    raise ValueError(f"unknown provider {provider!r}")


def embed_texts(provider: Provider, texts: Sequence[str], tries: int = 4, pause: float = 1.0) -> list[list[float]]:
    """Vectors checked for number, dimensions, finiteness and an unchanged identity; transient failures are retried, pausing twice as long each time."""
    return embed_matrix(provider, texts, tries, pause).tolist()


def embed_matrix(provider: Provider, texts: Sequence[str], tries: int = 4, pause: float = 1.0) -> np.ndarray:
    """The same as a matrix, a row a text."""
    before = provider.model_id, provider.params_hash
    whole = getattr(type(provider), "embed", None) is HashProvider.embed
    for k in range(tries):
        try:
            vectors = provider.matrix(texts) if whole else [list(map(float, v)) for v in provider.embed(texts)]
            break
        except TransientError:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    if (provider.model_id, provider.params_hash) != before:
        raise RuntimeError("the provider's identity changed while it embedded")
    if len(vectors) != len(texts) or any(len(v) != provider.dimensions for v in vectors):
        raise RuntimeError("the provider returned another number of vectors or dimensions")
    found = np.asarray(vectors, np.float64).reshape(len(texts), provider.dimensions)
    if not np.isfinite(found).all():
        raise RuntimeError("the provider returned a value that isn't finite")
    return found


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.astype(np.float32).ravel()))


def embed(chunks: DataFrame, provider: Provider, batch_size: int = 64) -> DataFrame:
    """(chunk_hash, text, token_count) with a column vector; batches go to the provider from the tasks."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch_size):
                part = b.slice(k, batch_size)
                vectors = embed_matrix(provider, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(vectors)], ["chunk_hash", "text", "token_count", "vector"])

    return chunks.select("chunk_hash", "text", F.col("token_count").cast("int")).mapInArrow(run, "chunk_hash string, text string, token_count int, vector array<float>")


def with_vectors(df: DataFrame, provider: Provider, batch_size: int = 64) -> DataFrame:
    """df with a column vector: the provider's for the column text; a null text counts as empty."""
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    at = df.columns.index("text")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch_size):
                part = b.slice(k, batch_size)
                vectors = embed_matrix(provider, [t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(vectors)], schema.names)

    return df.mapInArrow(run, schema)


def unique_inputs(chunks: DataFrame) -> DataFrame:
    """One (chunk_hash, text, token_count) a hash; fails if a hash comes with two texts or counts."""
    one = chunks.groupBy("chunk_hash").agg(F.min("text").alias("text"), F.max("text").alias("other"), F.min("token_count").alias("token_count"), F.max("token_count").alias("tokens"))
    bad = (F.col("text") != F.col("other")) | (F.col("token_count") != F.col("tokens"))
    checked = F.when(bad, F.raise_error(F.lit("a chunk hash has two contents"))).otherwise(F.col("text"))
    return one.select("chunk_hash", checked.alias("text"), "token_count")


def embed_with_cache(chunks: DataFrame, provider: Provider, cache, batch_size: int = 64, parts: int | None = None, part_rows: int = 10_000) -> tuple[DataFrame, int, int]:
    """(chunk_hash -> vector for all chunks, cache hits, newly embedded).

    Only hashes that the cache lacks are embedded; they are added to it in
    ``parts`` slices, by default of about part_rows and at most 64, each durable before the next begins, so a failed run goes on where it stopped.
    """
    from ..shared import written

    wanted = written(unique_inputs(chunks), "inputs")
    known = cache.vectors(provider.model_id, provider.params_hash)
    missing = written(wanted.join(known.select("chunk_hash"), "chunk_hash", "left_anti"), "missing")
    total, new = wanted.count(), missing.count()
    parts = parts or min(64, -(-new // part_rows))
    for k in range(parts if new else 0):
        part = missing if parts == 1 else missing.where(F.pmod(F.xxhash64("chunk_hash"), F.lit(parts)) == k)
        cache.put(embed(part, provider, batch_size), provider.model_id, provider.params_hash, provider.dimensions)
    known = cache.vectors(provider.model_id, provider.params_hash)
    return wanted.select("chunk_hash").join(known, "chunk_hash"), total - new, new

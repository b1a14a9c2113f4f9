"""Length-framed SHA-256 identities, as columns and in plain Python.

Every identity belongs to a namespace and a domain.  Fields are framed by their
byte lengths, so no two different field lists hash the same bytes.  State made
elsewhere with the same framing can be reproduced by naming its namespace.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "chunkloom"


def domain(kind: str, namespace: str = NAMESPACE) -> str:
    return f"{namespace}-{kind}-v1"


def framed(domain_: str, *fields: str | bytes) -> str:
    """The identity of plain values."""
    name = domain_.encode("ascii")
    parts = [len(name).to_bytes(4, "big"), name]
    for f in fields:
        raw = f if isinstance(f, bytes) else f.encode()
        parts += [len(raw).to_bytes(8, "big"), raw]
    return hashlib.sha256(b"".join(parts)).hexdigest()


def framed_col(domain_: str, *fields: Column) -> Column:
    """The same identity of string or binary columns, by built-in functions only."""
    name = domain_.encode("ascii")
    parts = [F.lit(len(name).to_bytes(4, "big") + name)]
    for f in fields:
        raw = f.cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw]
    return F.sha2(F.concat(*parts), 256)


def canonical_json(value: Mapping[str, Any]) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def json_hash(value: Mapping[str, Any], kind: str = "json", namespace: str = NAMESPACE) -> str:
    return framed(domain(kind, namespace), canonical_json(value))


def chunk_hash(text: str, chunker_id: str, params_hash: str, namespace: str = NAMESPACE) -> str:
    """Identity of a chunk's canonical text under one chunker; no embedding model takes part."""
    if not chunker_id or not params_hash:
        raise ValueError("chunker id and params hash must not be empty")
    return framed(domain("chunk", namespace), domain("chunk-identity", namespace), domain("normalizer", namespace), chunker_id, params_hash, text)


def chunk_hash_col(text: Column, chunker_id: str, params_hash: str, namespace: str = NAMESPACE) -> Column:
    return framed_col(domain("chunk", namespace), *map(F.lit, (domain("chunk-identity", namespace), domain("normalizer", namespace), chunker_id, params_hash)), text)


def instance_id_col(scope: Column, root: Column, document_id: Column, position: Column, chunk: Column, namespace: str = NAMESPACE) -> Column:
    """A repeatable row id: 32 hex digits over the zero-terminated fields."""
    parts = [F.lit(f"{namespace}:instance:v1".encode() + b"\0")]
    for f in (scope, root, document_id, position.cast("string"), chunk):
        parts += [f.cast("binary"), F.lit(b"\0")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def embedding_identity(provider: str, model: str, dimensions: int, base_url: str | None = None, namespace: str = NAMESPACE) -> tuple[str, str]:
    """(model_id, params_hash): what a cached vector depends on besides its chunk."""
    payload: dict[str, Any] = {"dimensions": dimensions, "model": model, "provider": provider}
    if provider == "hash":
        payload["version"] = 1
    elif provider == "openai":
        payload["base_url"] = base_url or "https://api.openai.com/v1"
    raw = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
    return f"{provider}:{model}", hashlib.sha256(f"{namespace}:embedding-params:v1".encode() + b"\0" + raw).hexdigest()


def leaf(value: Column, namespace: str = NAMESPACE) -> Column:
    return framed_col(domain("merkle-leaf", namespace), value)


def node(left: Column, right: Column, namespace: str = NAMESPACE) -> Column:
    return framed_col(domain("merkle-node", namespace), left, right)


def empty_root(namespace: str = NAMESPACE) -> str:
    return framed(domain("merkle-empty", namespace))


def merkle_root_col(leaves: Column, namespace: str = NAMESPACE, hashed: bool = False, levels: int | None = None) -> Column:
    """Merkle root of an array of non-empty strings, in order; a node without a sibling pairs with the empty string.

    hashed: the values are nodes already.  levels: go up exactly so many levels,
    which makes a subtree of a larger tree.
    """
    start = leaves if hashed else F.transform(leaves, lambda x: leaf(x, namespace))

    def up(level: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: node(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit("")), namespace))
        return pairs if levels is not None else F.when(F.size(level) > 1, pairs).otherwise(level)

    steps = F.sequence(F.lit(1), F.lit(levels)) if levels is not None else F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)))).cast("int")))
    return F.when(F.size(leaves) == 0, F.lit(empty_root(namespace))).otherwise(F.element_at(F.reduce(steps, start, up), 1))


def merkle_root(leaves: list[str], namespace: str = NAMESPACE) -> str:
    level = [framed(domain("merkle-leaf", namespace), x) for x in leaves]
    while len(level) > 1:
        level = [framed(domain("merkle-node", namespace), level[i], level[i + 1] if i + 1 < len(level) else "") for i in range(0, len(level), 2)]
    return level[0] if level else empty_root(namespace)

"""Configuration from TOML, validated strictly."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from ..errors import ConfigError
from ..functions.scoring import MAX_DIMENSIONS
from ..operators.chunking import STRATEGIES, Chunker, create_chunker
from ..operators.embedding import Provider, create_provider

FILE = "chunkloom.toml"
PROVIDERS = ("hash", "openai", "sentence-transformers")


@dataclass(frozen=True)
class ChunkerConfig:
    strategy: str = "cdc-rabin+snap"
    window_words: int = 48
    min_tokens: int = 180
    max_tokens: int = 640
    primary_mask_bits: int = 8
    backup_mask_bits: int = 6
    snap_window_words: int = 24
    overlap_tokens: int = 0
    similarity_threshold: float = 0.15

    def validate(self) -> None:
        _require(self.strategy in STRATEGIES, "chunker.strategy", f"is one of {', '.join(STRATEGIES)}")
        _require(self.window_words >= 2, "chunker.window_words", "is at least 2")
        _require(1 <= self.min_tokens < self.max_tokens, "chunker.min_tokens", "is at least 1 and less than max_tokens")
        _require(1 <= self.backup_mask_bits < self.primary_mask_bits <= 63, "chunker.backup_mask_bits", "is less than primary_mask_bits, which is at most 63")
        _require(self.snap_window_words >= 0, "chunker.snap_window_words", "is not negative")
        _require(0 <= self.overlap_tokens < self.max_tokens, "chunker.overlap_tokens", "is less than max_tokens")
        _require(0 <= self.similarity_threshold <= 1, "chunker.similarity_threshold", "is between 0 and 1")

    def build(self) -> Chunker:
        if self.strategy == "fixed":
            return create_chunker("fixed", size=self.max_tokens, overlap=self.overlap_tokens)
        if self.strategy == "recursive":
            return create_chunker("recursive", max_tokens=self.max_tokens, min_tokens=self.min_tokens)
        if self.strategy == "semantic":
            return create_chunker("semantic", max_tokens=self.max_tokens, min_tokens=self.min_tokens, threshold=self.similarity_threshold)
        names = ("window_words", "min_tokens", "max_tokens", "primary_mask_bits", "backup_mask_bits", "snap_window_words")
        return create_chunker(self.strategy, **{n: getattr(self, n) for n in names})


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "hash"
    model: str = ""
    dimensions: int = 256
    batch_size: int = 64
    base_url: str = ""
    usd_per_million_tokens: float = -1.0

    def validate(self) -> None:
        _require(self.provider in PROVIDERS, "embedding.provider", f"is one of {', '.join(PROVIDERS)}")
        _require(bool(self.model) or self.provider == "hash", "embedding.model", "is needed for this provider")
        _require(0 < self.dimensions <= MAX_DIMENSIONS, "embedding.dimensions", f"is 1 ... {MAX_DIMENSIONS}")
        _require(self.batch_size > 0, "embedding.batch_size", "is positive")

    @property
    def price(self) -> float | None:
        return None if self.usd_per_million_tokens < 0 else self.usd_per_million_tokens

    def build(self) -> Provider:
        return create_provider(self.provider, self.model or None, self.dimensions, self.base_url or None)


@dataclass(frozen=True)
class StoreConfig:
    cache: str = ".chunkloom/cache"
    index: str = ".chunkloom/index"

    def validate(self) -> None:
        _require(self.cache != self.index and bool(self.cache) and bool(self.index), "store", "has two different folders")


@dataclass(frozen=True)
class SourcesConfig:
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ("**/drafts/**", "**/.git/**", "**/.chunkloom/**")

    def validate(self) -> None:
        _require(bool(self.include), "sources.include", "names a pattern")


@dataclass(frozen=True)
class Config:
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    store: StoreConfig = field(default_factory=StoreConfig)
    sources: SourcesConfig = field(default_factory=SourcesConfig)
    path: str = FILE

    @property
    def base(self) -> Path:
        return Path(self.path).resolve().parent

    def folder(self, which: str) -> str:
        return str((self.base / getattr(self.store, which)).resolve())

    @property
    def journal(self) -> Path:
        return Path(self.path).resolve().with_name(Path(self.path).name + ".migration.json")


def _require(ok: bool, name: str, rule: str) -> None:
    if not ok:
        raise ConfigError(f"{name} must be a value that {rule}")


_SECTIONS: dict[str, type] = {"chunker": ChunkerConfig, "embedding": EmbeddingConfig, "store": StoreConfig, "sources": SourcesConfig}


def from_mapping(value: dict[str, Any], path: str = FILE) -> Config:
    """Unknown sections and keys and values of another type are errors."""
    unknown = set(value) - set(_SECTIONS)
    if unknown:
        raise ConfigError(f"unknown section {sorted(unknown)[0]!r}")
    parts = {}
    for name, kind in _SECTIONS.items():
        given, known = value.get(name, {}), {f.name: f for f in fields(kind)}
        if not isinstance(given, dict):
            raise ConfigError(f"{name} must be a section")
        made = {}
        for k, v in given.items():
            if k not in known:
                raise ConfigError(f"unknown key {name}.{k}")
            want = type(known[k].default)
            if want is tuple and isinstance(v, list) and all(isinstance(x, str) for x in v):
                v = tuple(v)
            elif want is float and type(v) is int:
                v = float(v)
            if type(v) is not want:
                raise ConfigError(f"{name}.{k} must be of type {want.__name__}")
            made[k] = v
        parts[name] = kind(**made)
        parts[name].validate()
    return Config(**parts, path=path)


def load(path: str = FILE, recovering: bool = False) -> Config:
    """Refuses while an unfinished migration's journal lies beside the file, unless recovering."""
    try:
        raw = Path(path).read_bytes()
    except OSError as e:
        raise ConfigError(f"{path} cannot be read: {e.strerror}") from e
    if len(raw) > 1 << 20:
        raise ConfigError(f"{path} is larger than 1 MiB")
    try:
        value = tomllib.loads(raw.decode())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path} is not TOML: {e}") from e
    config = from_mapping(value, path)
    if not recovering and config.journal.exists():
        raise ConfigError(f"{config.journal.name} tells of an unfinished migration: recover it first")
    return config


def render(config: Config) -> str:
    """The configuration as TOML."""
    lines = []
    for name in _SECTIONS:
        lines.append(f"[{name}]")
        for k, v in asdict(getattr(config, name)).items():
            lines.append(f"{k} = {json.dumps(list(v) if isinstance(v, tuple) else v)}")
        lines.append("")
    return "\n".join(lines)


def replace_file(path: Path, text: str) -> None:
    part = path.with_name(path.name + ".part")
    with open(part, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def adopt(source: str, path: str = FILE) -> Config:
    """Writes the configuration of another file of the same folder to path: state and sources stay where and what they are, nothing is embedded.

    Refused where path exists, or a journal tells of an unfinished migration of either file.
    """
    if Path(path).exists():
        raise ConfigError(f"{path} exists")
    old = load(source)
    new = Config(**{n: getattr(old, n) for n in _SECTIONS}, path=path)
    if new.journal.exists():
        raise ConfigError(f"{new.journal.name} tells of an unfinished migration: recover it first")
    if new.base != old.base:
        raise ConfigError("both files must lie in the same folder, from which state and sources are named")
    replace_file(Path(path).resolve(), render(new))
    return load(path)


def write_default(path: str = FILE, force: bool = False) -> Config:
    if Path(path).exists() and not force:
        raise ConfigError(f"{path} exists")
    config = Config(path=path)
    replace_file(Path(path).resolve(), render(config))
    return config

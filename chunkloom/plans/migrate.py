"""Moving an index to another chunker or model, with a journal, receipts and rollback.

A migration writes a journal before it touches anything, applies the plan, then
replaces the configuration and leaves a receipt.  After a crash the journal and
the state of the index tell whether to finish or to abort.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..errors import BackendError, ConfigError
from ..shared import written
from ..sources import files
from ..sources.cache import EmbeddingCache
from . import config as cf
from . import service
from .store import IndexStore, State


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Migration:
    old: cf.Config
    new: cf.Config
    plan: service.Prepared
    changes: dict[str, tuple[Any, Any]]


def opened(spark: SparkSession, config: cf.Config) -> tuple[IndexStore, EmbeddingCache]:
    return IndexStore(spark, config.folder("index")), EmbeddingCache(spark, config.folder("cache"))


def corpus(spark: SparkSession, config: cf.Config, inputs: tuple[str, ...] = ()):
    protected = [config.folder("index"), config.folder("cache"), str(Path(config.path).resolve()), str(config.journal), str(config.base / ".chunkloom")]
    paths = files.discover(str(config.base), inputs, config.sources.include, config.sources.exclude, protected)
    return files.unchanged(written(files.load(spark, str(config.base), paths), "sources"), str(config.base), paths)


def patched(config: cf.Config, chunker: dict[str, Any] | None = None, embedding: dict[str, Any] | None = None) -> cf.Config:
    import tomllib

    value = tomllib.loads(cf.render(config))
    value["chunker"] |= chunker or {}
    value["embedding"] |= embedding or {}
    return cf.from_mapping(value, config.path)


def prepare(spark: SparkSession, config: cf.Config, chunker: dict[str, Any] | None = None, embedding: dict[str, Any] | None = None) -> Migration:
    """What a change of chunker or model would do; writes nothing to index, cache or configuration."""
    new = patched(config, chunker, embedding)
    store, cache = opened(spark, config)
    plan = service.prepare(store, corpus(spark, config), new.chunker.build(), new.embedding.build(), cache, new.embedding.price)
    changes = {f"{s}.{k}": (v, getattr(getattr(new, s), k)) for s in ("chunker", "embedding") for k, v in getattr(config, s).__dict__.items() if v != getattr(getattr(new, s), k)}
    return Migration(config, new, plan, changes)


def _facts(state: State) -> dict[str, Any]:
    return {"generation": state.generation, "corpus_root": state.corpus_root, "model_id": state.model_id, "params_hash": state.params_hash}


def apply(spark: SparkSession, m: Migration) -> State:
    store, cache = opened(spark, m.old)
    journal = {"old": _facts(m.plan.before), "target": {"generation": m.plan.before.generation + 1, "corpus_root": m.plan.corpus_root, "model_id": m.plan.model[0], "params_hash": m.plan.model[1]}, "old_config": cf.render(m.old), "new_config": cf.render(m.new)}
    journal["checksum"] = _digest(json.dumps(journal, sort_keys=True))
    try:
        fd = os.open(m.old.journal, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    except FileExistsError as e:
        raise ConfigError("a migration is under way") from e
    with os.fdopen(fd, "w") as f:
        json.dump(journal, f)
        f.flush()
        os.fsync(f.fileno())
    if m.plan.requires_apply:
        service.apply(store, m.plan, m.new.embedding.build(), cache, m.new.embedding.batch_size)
    recover(spark, m.new)
    return store.state()


def _read(path: Path) -> dict[str, Any]:
    if path.stat().st_size > 4 << 20:
        raise BackendError("the journal is larger than 4 MiB")
    value = json.loads(path.read_text())
    given = value.pop("checksum", None)
    if given != _digest(json.dumps(value, sort_keys=True)):
        raise BackendError("the journal is damaged")
    return value


def recover(spark: SparkSession, config: cf.Config) -> str:
    """"none", "aborted" or "finished"; an index in neither the old nor the target state is left alone, with an error."""
    if not config.journal.exists():
        return "none"
    journal = _read(config.journal)
    now = _facts(opened(spark, config)[0].state())
    target = journal["target"]
    same_content = {k: now[k] for k in ("corpus_root", "model_id", "params_hash")} == {k: target[k] for k in ("corpus_root", "model_id", "params_hash")}
    if same_content and now["generation"] in (target["generation"], journal["old"]["generation"]):
        folder = config.base / ".chunkloom" / "receipts"
        folder.mkdir(parents=True, exist_ok=True)
        receipt = {k: journal[k] for k in ("old", "old_config", "new_config")} | {"now": now}
        receipt["checksum"] = _digest(json.dumps(receipt, sort_keys=True))
        cf.replace_file(folder / f"{now['generation']:08d}.json", json.dumps(receipt))
        cf.replace_file(Path(config.path).resolve(), journal["new_config"])
        outcome = "finished"
    elif now == journal["old"]:
        outcome = "aborted"
    else:
        raise BackendError("the index is in neither the old nor the target state")
    config.journal.unlink()
    return outcome


def prepare_rollback(spark: SparkSession, config: cf.Config) -> Migration:
    """The migration that undoes the newest one: its receipt must fit the index and the configuration as they are."""
    folder = config.base / ".chunkloom" / "receipts"
    now, text = _facts(opened(spark, config)[0].state()), Path(config.path).read_text()
    for path in sorted(folder.glob("*.json"), reverse=True) if folder.exists() else []:
        receipt = _read(path)
        if receipt["now"] == now and _digest(receipt["new_config"]) == _digest(text):
            import tomllib

            old = tomllib.loads(receipt["old_config"])
            m = prepare(spark, config, old["chunker"], old["embedding"])
            if m.plan.corpus_root != receipt["old"]["corpus_root"]:
                raise BackendError("the sources no longer give the state before the migration")
            return m
    raise BackendError("no receipt fits the index and its configuration")

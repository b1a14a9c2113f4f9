"""Configuration, command line and migrations on a small project."""

import json

import pytest
from chunkloom import cli
from chunkloom.errors import BackendError, ConfigError
from chunkloom.plans import config as cf
from chunkloom.plans import migrate


def test_configuration(tmp_path):
    path = str(tmp_path / "c.toml")
    made = cf.write_default(path)
    assert cf.load(path) == made
    with pytest.raises(ConfigError):
        cf.write_default(path)
    for bad in ({"other": {}}, {"chunker": {"none": 1}}, {"chunker": {"min_tokens": True}}, {"chunker": {"min_tokens": 640}}, {"embedding": {"provider": "x"}}, {"embedding": {"provider": "openai"}}, {"chunker": {"window_words": 1}}):
        with pytest.raises(ConfigError):
            cf.from_mapping(bad)
    made.journal.write_text("{}")
    with pytest.raises(ConfigError):
        cf.load(path)


def call(capsys, *args):
    code = cli.main([*args, "--json"])
    out = capsys.readouterr().out
    return code, json.loads(out.strip().splitlines()[-1]) if out.strip() else None


@pytest.fixture
def project(tmp_path, spark):
    path = str(tmp_path / "chunkloom.toml")
    config = migrate.patched(cf.Config(path=path), {"window_words": 4, "min_tokens": 8, "max_tokens": 24, "primary_mask_bits": 3, "backup_mask_bits": 2}, {"dimensions": 16})
    (tmp_path / "chunkloom.toml").write_text(cf.render(config))
    (tmp_path / "a.txt").write_text(" ".join(f"x{i * i % 97}" for i in range(150)))
    (tmp_path / "b.md").write_text("Some other words.\n\n" + " ".join(f"y{i}" for i in range(60)))
    return tmp_path, path


def test_commands(project, capsys):
    folder, path = project
    c = ("--config", path)
    code, plan = call(capsys, "plan", *c)
    assert code == 0 and plan["operations"]["add"] > 0 and plan["requires_apply"]
    code, done = call(capsys, "index", *c)
    assert code == 0 and done["generation"] == 1
    assert call(capsys, "index", *c)[1]["generation"] == 1
    code, hits = call(capsys, "query", "x1 x4 x9", "--limit", "2", *c)
    assert code == 0 and len(hits) == 2 and hits[0]["document_id"] == "a.txt"
    assert call(capsys, "verify", *c) == (0, {"ok": True, "problems": []})
    (folder / "b.md").unlink()
    assert cli.main(["index", *c]) == 2  # deletes, without consent
    assert call(capsys, "index", "--allow-delete", *c)[1]["generation"] == 2
    assert call(capsys, "status", *c)[1]["tombstoned"] > 0
    assert call(capsys, "compact", "--before", "2999-01-01T00:00:00+00:00", *c)[1]["tombstones"] > 0
    assert call(capsys, "cache-stats", *c)[1]["entries"] > 0
    assert cli.main(["query", " ", *c]) == 2
    assert cli.main(["status", "--config", str(folder / "none.toml")]) == 2


def test_migration_rollback_and_recovery(project, spark):
    _, path = project
    config = cf.load(path)
    from chunkloom.plans import service

    store, cache = migrate.opened(spark, config)
    first = service.apply(store, service.prepare(store, migrate.corpus(spark, config), config.chunker.build(), config.embedding.build(), cache), config.embedding.build(), cache)
    with pytest.raises(BackendError):
        migrate.prepare_rollback(spark, config)
    m = migrate.prepare(spark, config, {"max_tokens": 16})
    assert m.changes == {"chunker.max_tokens": (24, 16)}
    assert migrate.apply(spark, m).generation == 2
    moved = cf.load(path)
    assert moved.chunker.max_tokens == 16 and not moved.journal.exists()
    back = migrate.prepare_rollback(spark, moved)
    assert migrate.apply(spark, back).corpus_root == first.corpus_root and cf.load(path).chunker.max_tokens == 24
    # a journal left before anything was applied is dropped
    again = migrate.prepare(spark, cf.load(path), {"max_tokens": 20})
    journal = {"old": migrate._facts(again.plan.before), "target": {"generation": 9, "corpus_root": "r", "model_id": "m", "params_hash": "p"}, "old_config": "", "new_config": ""}
    journal["checksum"] = migrate._digest(json.dumps(journal, sort_keys=True))
    again.old.journal.write_text(json.dumps(journal))
    assert migrate.recover(spark, again.old) == "aborted" and migrate.recover(spark, again.old) == "none"

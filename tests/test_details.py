"""Text folding, file names, cache commits, deltas, manifests and gates in detail."""

import json
import os
import re
import unicodedata

import pytest
from chunkloom import cli
from chunkloom.errors import BackendError, ConfigError, SourceError
from chunkloom.functions import identity as I
from chunkloom.functions import text as tx
from chunkloom.operators import chunking as ch
from chunkloom.operators import embedding
from chunkloom.plans import config as cf
from chunkloom.plans import manifest as mf
from chunkloom.plans import migrate, service
from chunkloom.plans.store import IndexStore, float_bytes
from chunkloom.sources import files
from chunkloom.sources.cache import EmbeddingCache
from pyspark.sql import functions as F

from .test_index import CHUNKER, docs, run, text

# --- text -------------------------------------------------------------------


def test_folding_is_full_case_folding(spark):
    known = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x20000))) if unicodedata.category(c) != "Cn"]
    words = ["ΟΔΟΣ ΣΑΣ", "Straße STRASSE ẞ", "ﬁn ﬃ", "İstanbul ıI", "ſo µ ŉ ΐ", "plain ASCII", ""]
    df = spark.createDataFrame([(c,) for c in known + words], "t string")
    off = [r.t for r in df.select("t", tx.folded(F.col("t")).alias("f")).collect() if r.f != r.t.casefold()]
    assert not [w for w in words if w in off] and len(off) <= 0.001 * len(known), off[:20]  # but for letters that one of the two Unicode versions lacks


def test_control_characters_in_texts(spark):
    raws = ["a\u0001b c", "\u0001 x\n\n\u0001y \u0002", "\u0002a\u0001\u0002b \n \n\u0001", "one\n\n\u0001two", "plain"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(raws)], "document_id string, text string")
    got = {r.document_id: (r.text, r.chunk_hash) for r in ch.fixed_chunks(df, 100).collect()}
    want = {r.document_id: (r.text, r.chunk_hash) for r in ch.chunk_documents(df, ch.Fixed(size=100)).collect()}
    assert got == want and got["0"][0] == raws[0]


def test_identities_are_pinned():
    # the frame: length of the domain in four bytes, of each field in eight
    import hashlib

    assert I.framed("d", "a", "bc") == hashlib.sha256(b"\0\0\0\1d" + b"\0" * 7 + b"\1a" + b"\0" * 7 + b"\2bc").hexdigest()
    leaves = ["a", "b", "c"]
    leaf = [I.framed("n-merkle-leaf-v1", x) for x in leaves]
    node = lambda a, b: I.framed("n-merkle-node-v1", a, b)
    assert I.merkle_root(leaves, "n") == node(node(leaf[0], leaf[1]), node(leaf[2], "")) and I.merkle_root([], "n") == I.framed("n-merkle-empty-v1")
    w = hashlib.blake2b(b"Wword", digest_size=8, person=b"n-word-v1").digest()
    assert ch.word_symbol("word", False, "n") == int.from_bytes(w, "big") != ch.word_symbol("word", True, "n")


# --- sources ----------------------------------------------------------------


def test_names_are_literal_and_drift_is_seen(spark, tmp_path):
    names = ["a{b}.md", "c[d].txt", "e*f?.yml", "g h+%41.xml", "k.conf", "l.tex", "é.md"]
    for n in names:
        (tmp_path / n).write_text(n)
    (tmp_path / "a.md").write_text("not asked for")
    for n in ("x.kt", "x.adoc", "x.bash"):
        (tmp_path / n).write_text("no source")
    assert files.discover(str(tmp_path)) == sorted([*names, "a.md"])
    loaded = files.load(spark, str(tmp_path), names).cache()
    assert {r.document_id: r.text for r in loaded.collect()} == {n: n for n in names}
    assert files.unchanged(loaded, str(tmp_path), names) is loaded
    os.utime(tmp_path / "k.conf", (1, 1))
    with pytest.raises(SourceError, match="k.conf"):
        files.unchanged(loaded, str(tmp_path), names)


# --- cache ------------------------------------------------------------------


def entries(spark, n=4):
    return spark.createDataFrame([(f"h{i}", [float(i), 1.0], 3) for i in range(n)], "chunk_hash string, vector array<float>, token_count int")


def test_a_prune_that_crashes_loses_nothing(spark, tmp_path, monkeypatch):
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache")
    cache.put(entries(spark), "m", "p", 2)
    cache.touch(entries(spark).where("chunk_hash = 'h1'"), "m", "p")
    real = cache._fs
    monkeypatch.setattr(cache, "_fs", lambda p: (_ for _ in ()).throw(OSError()) if "/commits/" in p else real(p))
    with pytest.raises(OSError):
        cache.prune(max_entries=2)
    monkeypatch.setattr(cache, "_fs", real)
    assert cache.stats()["entries"] == 4
    assert cache.prune(max_entries=2) == 2 and cache.get("h1", "m", "p") == [1.0, 1.0] and cache.get("h3", "m", "p") is None and cache.get("h1", "m", "q") is None
    cache.put(entries(spark, 6), "m", "p", 2)
    assert cache.stats()["entries"] == 6 and cache.prune(max_entries=1) == 5 and cache.stats()["entries"] == 1


def test_imports_have_limits(spark, tmp_path, monkeypatch):
    from chunkloom.sources import cache as module

    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache")
    cache.put(entries(spark), "m", "p", 2)
    out = f"file://{tmp_path}/out"
    cache.export_jsonl(out)
    other = EmbeddingCache(spark, f"file://{tmp_path}/other")
    for name in ("IMPORT_BYTES", "IMPORT_LINE"):
        with monkeypatch.context() as m:
            m.setattr(module, name, 50)
            with pytest.raises(BackendError, match="more than 50"):
                other.import_jsonl(out, trusted=True)
    assert other.import_jsonl(out, trusted=True) == 4


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    class Failing(embedding.HashProvider):
        def embed(self, texts):
            if any("poison" in t for t in texts) and not (tmp_path / "healed").exists():
                raise RuntimeError("down")
            return super().embed(texts)

    cache, provider = EmbeddingCache(spark, f"file://{tmp_path}/cache"), Failing(8)
    rows = spark.createDataFrame([(f"h{i}", f"text {i}" + " poison" * (i == 17), 2) for i in range(40)], "chunk_hash string, text string, token_count int")
    with pytest.raises(Exception, match="down"):
        embedding.embed_with_cache(rows, provider, cache, 4, part_rows=5)
    kept = cache.stats()["entries"]
    (tmp_path / "healed").touch()
    _, hits, new = embedding.embed_with_cache(rows, provider, cache, 4, part_rows=5)
    assert hits == kept and hits + new == 40 and cache.stats()["entries"] == 40


# --- manifests and deltas ---------------------------------------------------


@pytest.fixture
def place(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index"), EmbeddingCache(spark, f"file://{tmp_path}/cache"), embedding.HashProvider(16)


def test_manifests_round_trip(spark, tmp_path):
    given = spark.createDataFrame([("a", text("x"), '{"k":[1,{"b":"ü\\""}]}'), ('b"\\', "", None), ("c", text("y", 30), None)], "document_id string, text string, metadata string")
    chunks = ch.chunk_documents(given, CHUNKER)
    made = mf.document_manifests(chunks, given)
    plain = lambda df: sorted(map(str, df.select(*mf.FIELDS).collect()))
    rows = mf.to_json(made)
    for r in rows.collect():
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and value["document_id"] == r.document_id
        assert value["root_hash"] == I.merkle_root([c["chunk_hash"] for c in value["chunks"]])
    assert plain(mf.from_json(rows)) == plain(made)
    root = mf.write_mirror(made, f"file://{tmp_path}/m", note="n")
    mf.write_mirror(made, f"file://{tmp_path}/m")  # again, in its place
    header, back = mf.read_mirror(spark, f"file://{tmp_path}/m")
    assert header["root_hash"] == root and plain(back) == plain(made)
    change = lambda a, b: rows.withColumn("json", F.replace("json", F.lit(a), F.lit(b)))
    some = chunks.where("document_id = 'a'").first().chunk_hash
    for bad, said in ((change(some, "0" * 64), "root"), (change('"schema_version":1', '"schema_version":9'), "version"), (change('"document_id":"a"', '"document_id":""'), "id"), (rows.withColumn("json", F.lit("{")), "(?i)json|variant")):
        with pytest.raises(Exception, match=said):
            mf.from_json(bad).collect()
    two = chunks.withColumn("params_hash", F.when(F.col("position") == 0, "other").otherwise(F.col("params_hash")))
    with pytest.raises(Exception, match="two chunkers"):
        mf.document_manifests(two, given).collect()
    less = mf.without_documents(made, spark.createDataFrame([("a",)], "document_id string"))
    assert sorted(r.document_id for r in less.collect()) == ['b"\\', "c"] and plain(mf.with_documents(less, made.where("document_id = 'a'"))) == plain(made) == plain(mf.with_documents(made, made))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_a_change_of_one_document_writes_that_document(spark, place, tmp_path):
    store, cache, provider = place
    many = {f"d{i:03d}": text(f"t{i}", 400) for i in range(60)}
    run(place, docs(spark, **many))
    before = size(tmp_path / "index")
    run(place, docs(spark, **(many | {"d007": text("new", 400)})))
    assert size(tmp_path / "index") - before < 0.25 * before
    assert service.verify(store).count() == 0 and store.documents().count() == 60
    plan = service.prepare(store, docs(spark, d008=text("other", 300)), CHUNKER, provider, cache, scope=spark.createDataFrame([("d008",), ("d009",), ("none",)], "document_id string"))
    state = service.apply(store, plan, provider, cache)
    assert state.generation == 3 and len(state.folders) == 3 and service.verify(store).count() == 0
    assert {r.document_id for r in store.documents().collect()} == set(many) - {"d009"} == {r.document_id for r in store.active().select("document_id").distinct().collect()}
    rows = lambda: sorted(map(str, store.chunks().drop("vector").collect()))
    was, status = rows(), store.status()
    merged = store.merge()
    assert rows() == was and len(merged.folders) == 1 and store.status() == status | {"generation": 4} and service.verify(store).count() == 0
    assert len(store.vacuum(1)) == 3 and rows() == was and store.state() == merged
    with pytest.raises(BackendError):
        service.prepare(store, docs(spark, d008="x"), CHUNKER, embedding.HashProvider(8), cache, scope=spark.createDataFrame([("d008",)], "document_id string"))


def test_metadata_of_a_document_without_chunks(spark, place):
    given = lambda m: spark.createDataFrame([("a", text("x"), None), ("b", "", m)], "document_id string, text string, metadata string")
    run(place, given(None))
    plan, state = run(place, given('{"k":1}'))
    assert plan.requires_apply and state.generation == 2 and {r.document_id: r.metadata for r in place[0].documents().collect()} == {"a": None, "b": '{"k":1}'}
    assert run(place, given('{"k":1}'))[1].generation == 2
    assert service.write_mirror(place[0]) == state.corpus_root
    assert mf.read_mirror(spark, f"{place[0].root}/manifest")[0]["generation"] == 2


def test_tombstones_stay_dead_and_content_stays(spark, place):
    store, cache, provider = place
    run(place, docs(spark, a=text("x"), b=text("y")))
    rows = store.active().cache()
    state = store.state()
    facts = (state.corpus_root, state.model_id, state.params_hash, 16)
    store.apply(rows.where("document_id = 'a'"), store.documents(), store.manifests(), state, *facts)
    with pytest.raises(BackendError, match="tombstoned"):
        store.apply(rows, store.documents(), store.manifests(), store.state(), *facts)
    with pytest.raises(Exception, match="another content"):
        store.apply(rows.where("document_id = 'a'").withColumn("text", F.lit("t")), store.documents(), store.manifests(), store.state(), *facts)


def test_vectors_are_digested_by_their_bytes(spark):
    import struct

    vectors = [[1.5, -2.0], [], None, [float("inf")], [0.1, 1e-40, 3.0]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vectors], "v array<float>").select(float_bytes("v")).collect()]
    assert [bytes(g) for g in got] == [b"".join(struct.pack("<f", x) for x in v or []) for v in vectors]


# --- command line -----------------------------------------------------------


def test_gates_of_migrations_and_adopt(spark, tmp_path, capsys):
    path = str(tmp_path / "chunkloom.toml")
    config = migrate.patched(cf.Config(path=path), {"window_words": 4, "min_tokens": 8, "max_tokens": 24, "primary_mask_bits": 3, "backup_mask_bits": 2}, {"dimensions": 16})
    (tmp_path / "chunkloom.toml").write_text(cf.render(config))
    (tmp_path / "a.txt").write_text(text("x"))
    c = ("--config", path, "--json")
    assert cli.main(["index", *c]) == 0 and os.path.isdir(tmp_path / ".chunkloom" / "index" / "manifest")
    for change in (("--embedding", '{"dimensions": 8}'), ("--chunker", '{"max_tokens": 16}')):
        assert cli.main(["migrate", "--apply", *change, *c]) == 2
    capsys.readouterr()
    assert cli.main(["status", *c]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["generation"] == 1
    assert cli.main(["migrate", "--apply", "--allow-delete", "--embedding", '{"dimensions": 8}', *c]) == 0
    other = str(tmp_path / "other.toml")
    assert cli.main(["adopt", "--from-config", path, "--config", other]) == 0 and cf.load(other).folder("index") == cf.load(path).folder("index")
    (tmp_path / "sub").mkdir()
    for target in (other, str(tmp_path / "sub" / "x.toml")):
        assert cli.main(["adopt", "--from-config", path, "--config", target]) == 2
    cf.Config(path=str(tmp_path / "third.toml")).journal.write_text("{}")
    with pytest.raises(ConfigError, match="unfinished"):
        cf.adopt(path, str(tmp_path / "third.toml"))
    for left in ("a.txt", "other.toml", "third.toml.migration.json"):
        (tmp_path / left).unlink()
    assert cli.main(["index", "--allow-delete", *c]) == 2 and cli.main(["index", "--allow-delete", "--allow-empty", *c]) == 0
    assert re.search("empties", capsys.readouterr().err)

"""The index from plan to compaction, the cache, sources and the stream."""

from datetime import datetime, timedelta, timezone

import pytest
from chunkloom.errors import BackendError, SourceError, StaleError
from chunkloom.operators import chunking as ch
from chunkloom.operators.embedding import HashProvider
from chunkloom.plans import service
from chunkloom.plans.store import IndexStore
from chunkloom.sources import files
from chunkloom.sources.cache import EmbeddingCache
from pyspark.sql import functions as F

CHUNKER = ch.ContentDefined(window_words=4, min_tokens=8, max_tokens=24, primary_mask_bits=3, backup_mask_bits=2)


def docs(spark, **texts):
    return spark.createDataFrame([(k, v, None) for k, v in texts.items()] or [], "document_id string, text string, metadata string")


def text(seed, n=120):
    return " ".join(f"{seed}{i * i % 97}" for i in range(n))


@pytest.fixture
def place(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index"), EmbeddingCache(spark, f"file://{tmp_path}/cache"), HashProvider(16)


def run(place, corpus):
    store, cache, provider = place
    plan = service.prepare(store, corpus, CHUNKER, provider, cache)
    return plan, service.apply(store, plan, provider, cache)


def test_life_of_an_index(spark, place):
    store, cache, provider = place
    plan, state = run(place, docs(spark, a=text("x"), b=text("y")))
    assert state.generation == 1 and plan.counts["add"] > 0 and service.verify(store).count() == 0
    hits = service.query(store, provider, text("x", 20), 3).collect()
    assert len(hits) == 3 and hits[0].document_id == "a"
    # nothing new: no generation
    plan, state = run(place, docs(spark, a=text("x"), b=text("y")))
    assert state.generation == 1 and not plan.requires_apply
    # an edit embeds only what is new; a document left out is deleted
    entries = cache.stats()["entries"]
    plan, state = run(place, docs(spark, a=text("x") + " some closing words that are new"))
    assert state.generation == 2 and plan.counts["delete"] > 0 and plan.counts["keep"] > 0
    assert cache.stats()["entries"] - entries == plan.cost["chunks_to_embed"] > 0
    status = store.status()
    assert status["tombstoned"] > 0 and status["documents"] == 1
    # back again: the vectors are in the cache
    plan, state = run(place, docs(spark, a=text("x"), b=text("y")))
    assert state.generation == 3 and plan.cost["chunks_to_embed"] == 0 and service.verify(store).count() == 0
    later = datetime.now(timezone.utc) + timedelta(minutes=1)
    assert store.compact(later, dry_run=True) == store.compact(later) > 0
    assert store.status()["tombstoned"] == 0 and service.verify(store).count() == 0
    with pytest.raises(ValueError):
        store.compact(datetime(2024, 1, 1))


def test_a_stale_plan_is_refused(spark, place):
    store, cache, provider = place
    first = service.prepare(store, docs(spark, a=text("x")), CHUNKER, provider, cache)
    second = service.prepare(store, docs(spark, a=text("z")), CHUNKER, provider, cache)
    service.apply(store, first, provider, cache)
    with pytest.raises(StaleError):
        service.apply(store, second, provider, cache)


def test_another_model_embeds_everything(spark, place):
    store, cache, _ = place
    run(place, docs(spark, a=text("x")))
    other = HashProvider(8)
    plan = service.prepare(store, docs(spark, a=text("x")), CHUNKER, other, cache)
    assert plan.embed_all and plan.requires_apply
    assert service.apply(store, plan, other, cache).dimensions == 8
    with pytest.raises(BackendError):
        service.query(store, HashProvider(16), "x1 x4")


def test_empty_index(spark, place):
    store, cache, provider = place
    assert store.status()["generation"] == 0
    with pytest.raises(BackendError):
        service.query(store, provider, "word")
    plan, state = run(place, docs(spark))
    assert state.generation == 1 and store.status()["active"] == 0


def test_repeated_ids_are_refused(spark, place):
    twice = docs(spark, a="x").union(docs(spark, a="y"))
    with pytest.raises(SourceError):
        service.prepare(place[0], twice, CHUNKER, place[2], place[1])


def test_cache(spark, place, tmp_path):
    cache = place[1]
    rows = spark.createDataFrame([(f"h{i}", [float(i), 1.0], 3) for i in range(4)], "chunk_hash string, vector array<float>, token_count int")
    cache.put(rows, "m", "p", 2)
    cache.put(rows, "m", "p", 2)
    assert cache.stats() == {"entries": 4, "chunks": 4, "models": 1, "bytes": 32}
    with pytest.raises(BackendError):
        cache.put(rows.withColumn("token_count", F.lit(9)), "m", "p", 2)
    cache.export_jsonl(f"file://{tmp_path}/out")
    with pytest.raises(BackendError):
        cache.import_jsonl(f"file://{tmp_path}/out")
    other = EmbeddingCache(spark, f"file://{tmp_path}/other")
    assert other.import_jsonl(f"file://{tmp_path}/out", trusted=True) == 4 and other.stats()["entries"] == 4
    cache.touch(rows.where("chunk_hash = 'h2'"), "m", "p")
    assert cache.prune(max_entries=1) == 3
    assert [r.chunk_hash for r in cache.entries().collect()] == ["h2"]
    with pytest.raises(ValueError):
        cache.prune()


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "drafts").mkdir(parents=True)
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfone two")
    (tmp_path / "sub" / "b.TXT").write_text("three")
    (tmp_path / "sub" / "drafts" / "c.md").write_text("four")
    (tmp_path / "d.png").write_bytes(b"\x89")
    found = files.discover(str(tmp_path), excludes=["**/drafts/**"])
    assert found == ["a.md", "sub/b.TXT"]
    got = {r.document_id: r.text for r in files.load(spark, str(tmp_path), found).collect()}
    assert got == {"a.md": "one two", "sub/b.TXT": "three"}
    assert files.discover(str(tmp_path), inputs=["sub"], excludes=["*/drafts/*"]) == ["sub/b.TXT"]
    for bad in (["missing"], ["/etc"]):
        with pytest.raises(SourceError):
            files.discover(str(tmp_path), inputs=bad)
    (tmp_path / "e.txt").write_bytes(b"x\0y")
    with pytest.raises(Exception, match="binary file"):
        files.load(spark, str(tmp_path), ["e.txt"]).collect()
    assert files.load(spark, str(tmp_path), []).count() == 0


def test_stream(spark, place, tmp_path):
    from chunkloom.streaming import ingest

    store, cache, provider = place
    schema = ingest.CHANGES
    spark.createDataFrame([("a", text("x"), None, 1, False), ("a", text("w"), None, 2, False), ("b", text("y"), None, 1, False)], schema).write.parquet(f"{tmp_path}/in/1")
    for step in (1, 2):
        if step == 2:
            spark.createDataFrame([("b", None, None, 3, True)], schema).write.parquet(f"{tmp_path}/in/2")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ingest.ingest(stream, store, CHUNKER, provider, cache, f"file://{tmp_path}/check").awaitTermination()
        assert store.status()["generation"] == step
    assert [r.document_id for r in store.documents().collect()] == ["a"]

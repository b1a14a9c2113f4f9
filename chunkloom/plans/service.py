"""Plan, apply, query and verify: a desired corpus against the committed index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BackendError, StaleError
from ..functions import identity
from ..operators import diff, merkle
from ..operators.chunking import Chunker, chunk_documents
from ..operators.embedding import Provider, embed_texts, embed_with_cache
from ..shared import written
from ..sources.cache import EmbeddingCache
from ..sources.files import unique_ids
from . import manifest as mf
from . import store as st


@dataclass
class Prepared:
    """A plan against one state of the index; nothing has been written to index or cache."""

    before: st.State
    documents: DataFrame
    chunks: DataFrame
    operations: DataFrame
    cost: dict
    counts: dict[str, int]
    corpus_root: str
    embed_all: bool
    model: tuple[str, str]
    manifests: DataFrame
    changed_documents: int  # whose state is not as committed, be it the metadata of one without chunks
    scope: DataFrame | None = None

    @property
    def requires_apply(self) -> bool:
        return self.embed_all or self.before.generation == 0 or self.changed_documents > 0 or self.corpus_root != self.before.corpus_root or any(n for k, n in self.counts.items() if k != "keep")


def prepare(store: st.IndexStore, docs: DataFrame, chunker: Chunker, provider: Provider, cache: EmbeddingCache, usd_per_million: float | None = None, force_embed_all: bool = False, scope: DataFrame | None = None) -> Prepared:
    """docs (document_id, text, metadata) are the complete corpus: committed documents not among them are deleted.

    With a scope (document_id) docs are the new states of these documents only; those of them that docs lacks are deleted, and all others stay as they are, unread.
    """
    before = store.state()
    inside = lambda df: df if scope is None else df.join(scope.select("document_id"), "document_id", "left_semi")
    docs = unique_ids(docs)
    metadata = F.col("metadata") if "metadata" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("document_id").cast("string"), "text", metadata.alias("metadata"))
    chunks = written(chunk_documents(docs, chunker), "chunks")
    hard = chunks.groupBy("document_id").agg(F.count_if(F.col("boundary_kind") == "hard").alias("hard_cuts"))
    roots = merkle.document_roots(chunks, docs, store.namespace)
    documents = written(roots.join(hard, "document_id", "left").fillna(0, ["hard_cuts"]).join(docs.select("document_id", "metadata"), "document_id").select("document_id", "root_hash", "chunk_count", "hard_cuts", "metadata"), "documents")
    manifests = written(mf.document_manifests(chunks, docs, store.namespace), "manifests")
    everywhere = documents if scope is None else store.documents().join(scope.select("document_id"), "document_id", "left_anti").unionByName(documents)
    root = merkle.corpus_root(everywhere, store.namespace).collect()[0].corpus_root
    old, committed = inside(store.active()), inside(store.documents())
    changed = committed.select("document_id", F.col("metadata").alias("was")).join(documents.select("document_id", F.col("metadata").alias("is")), "document_id").where(~F.col("was").eqNullSafe(F.col("is"))).select("document_id")
    operations = written(diff.plan_operations(old, chunks, changed), "operations")
    model = provider.model_id, provider.params_hash
    different = st.changes(committed, documents, ["document_id", "root_hash", "chunk_count", "hard_cuts", "metadata"], 0).count()
    embed_all = force_embed_all or (before.generation > 0 and (before.model_id, before.params_hash) != model)
    cost = diff.cost(operations, chunks, cache.vectors(*model), usd_per_million, embed_all).collect()[0].asDict()
    counts = {r.kind: r.n for r in diff.counts(operations).collect()}
    if embed_all and scope is not None:
        raise BackendError("another model needs the whole corpus, not some documents")
    return Prepared(before, documents, chunks, operations, cost, counts, root, embed_all, model, manifests, different, scope)


def resolve_identities(operations: DataFrame, current: DataFrame, scope: str, root: str, namespace: str = identity.NAMESPACE) -> DataFrame:
    """(document_id, position, chunk_hash, instance_id): kept and moved chunks carry their row's id, added ones get a new one."""
    old = current.select("document_id", F.col("position").alias("old_position"), "chunk_hash", "instance_id")
    made = identity.instance_id_col(F.lit(scope), F.lit(root), F.col("document_id"), F.col("new_position"), F.col("chunk_hash"), namespace)
    wanted = operations.where("new_position IS NOT NULL").join(old, ["document_id", "old_position", "chunk_hash"], "left")
    return wanted.select("document_id", F.col("new_position").alias("position"), "chunk_hash", F.coalesce("instance_id", made).alias("instance_id"))


def apply(store: st.IndexStore, plan: Prepared, provider: Provider, cache: EmbeddingCache, batch_size: int = 64, parts: int | None = None) -> st.State:
    """Embeds what neither the index nor the cache has, and commits the next generation; a plan that changes nothing commits nothing."""
    if store.state() != plan.before:
        raise StaleError("the index has changed since the plan was made")
    if (provider.model_id, provider.params_hash) != plan.model:
        raise RuntimeError("the provider's identity differs from the plan's")
    if not plan.requires_apply:
        return plan.before
    current = store.active().limit(0) if plan.embed_all else store.active() if plan.scope is None else store.active().join(plan.scope.select("document_id"), "document_id", "left_semi")
    scope = f"{plan.model[0]}\0{plan.model[1]}\0generation:{plan.before.generation + 1}"
    operations = plan.operations.withColumn("old_position", F.lit(None).cast("int")) if plan.embed_all else plan.operations
    ids = resolve_identities(operations, current, scope, plan.corpus_root, store.namespace)
    reused = current.join(plan.chunks.select("chunk_hash").distinct(), "chunk_hash", "left_semi").groupBy("chunk_hash").agg(F.min_by("vector", "instance_id").alias("vector"))
    missing = plan.chunks.join(reused.select("chunk_hash"), "chunk_hash", "left_anti")
    vectors, _, _ = embed_with_cache(missing, provider, cache, batch_size, parts)
    vectors = written(vectors.unionByName(reused), "vectors")
    rows = plan.chunks.withColumnRenamed("params_hash", "chunker_params_hash").join(ids, ["document_id", "position", "chunk_hash"]).join(vectors, "chunk_hash")
    rows = rows.select(
        "instance_id", "document_id", "position", "chunk_hash", "text", "start_offset", "end_offset", "token_count", "boundary_kind", "vector", F.lit(provider.dimensions).alias("dimensions"),
        F.lit(plan.model[0]).alias("model_id"), F.lit(plan.model[1]).alias("params_hash"), "metadata", "chunker_id", "chunker_params_hash",
    )
    rows = written(rows, "rows")
    if rows.count() != plan.chunks.count():
        raise BackendError("a chunk has no vector or no identity")
    return store.apply(rows, plan.documents, plan.manifests, plan.before, plan.corpus_root, *plan.model, provider.dimensions, plan.scope)


def query(store: st.IndexStore, provider: Provider, text: str, limit: int = 10) -> DataFrame:
    if not text.strip():
        raise ValueError("an empty query finds nothing")
    return store.query(embed_texts(provider, [text])[0], limit, provider.model_id, provider.params_hash)


def verify(store: st.IndexStore) -> DataFrame:
    s = store.state()
    if s.generation == 0:
        raise BackendError("there is no index to verify")
    problems = st.verify(store.chunks(), store.documents(), store.manifests(), s.dimensions or 0, s.model_id or "", s.params_hash or "", store.namespace)
    root = merkle.corpus_root(mf.documents(store.manifests()), store.namespace).collect()[0].corpus_root
    whole = [("corpus root is absent", not s.corpus_root), ("corpus root differs", bool(s.corpus_root) and root != s.corpus_root), ("embedding model identity is absent", not s.model_id or not s.params_hash), ("index dimensions are not a positive integer", type(s.dimensions) is not int or s.dimensions < 1)]
    return problems.unionByName(store.spark.createDataFrame([(None, None, p) for p, bad in whole if bad], "document_id string, position int, problem string"))


def write_mirror(store: st.IndexStore, path: str | None = None) -> str:
    """The committed manifest as JSON lines, beside the index; its root."""
    s = store.state()
    if s.generation == 0:
        raise BackendError("there is no index")
    return mf.write_mirror(store.manifests(), path or f"{store.root}/manifest", store.namespace, generation=s.generation, model_id=s.model_id, params_hash=s.params_hash)

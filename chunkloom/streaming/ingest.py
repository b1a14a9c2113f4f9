"""A stream of document changes into the index: one generation for each micro-batch that changes something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import Chunker
from ..operators.embedding import Provider
from ..plans import service
from ..plans.store import IndexStore
from ..shared import written
from ..sources.cache import EmbeddingCache

CHANGES = "document_id string, text string, metadata string, version long, deleted boolean"


def upsert(corpus: DataFrame, changes: DataFrame) -> DataFrame:
    """corpus (document_id, text, metadata) after changes; of several changes of one document the latest version counts."""
    new = latest(changes)
    kept = corpus.join(new.select("document_id"), "document_id", "left_anti")
    return kept.unionByName(new.where("NOT deleted").select("document_id", "text", "metadata"))


def latest(changes: DataFrame) -> DataFrame:
    """The change of each document that counts: of several the one of the greatest version, of equal ones a deletion, then the greatest text."""
    rank = F.struct("version", F.coalesce("deleted", F.lit(False)).alias("d"), "text", "metadata")
    return changes.groupBy("document_id").agg(F.max_by(F.struct("text", "metadata", F.coalesce("deleted", F.lit(False)).alias("deleted")), rank).alias("c")).select("document_id", "c.*")


def ingest(changes: DataFrame, store: IndexStore, chunker: Chunker, provider: Provider, cache: EmbeddingCache, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the stream.  Each micro-batch plans and writes the documents it changes, and no others; of one document the later
    batch counts.  A batch that is run again finds its documents as it left them and publishes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        new = written(latest(df), "changes")
        if not new.limit(1).count():
            return
        plan = service.prepare(store, new.where("NOT deleted").drop("deleted"), chunker, provider, cache, scope=new.select("document_id"))
        service.apply(store, plan, provider, cache)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

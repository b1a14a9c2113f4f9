"""Differences between a committed and a desired corpus, and what they cost.

Chunk tables have (document_id, position, chunk_hash, start_offset, end_offset,
token_count, metadata); metadata is canonical JSON or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import price

KINDS = ("keep", "move", "add", "delete")
_FIELDS = ("position", "start_offset", "end_offset", "token_count", "metadata")


def plan_operations(old: DataFrame, new: DataFrame, changed_documents: DataFrame | None = None) -> DataFrame:
    """(document_id, kind, chunk_hash, old_position, new_position, old_token_count, new_token_count).

    A multiset match within each document: first equal (hash, start, end), in
    the order of positions, then equal hashes among the rest.  An exact match
    is kept only if token count and metadata are the same and the document's own
    metadata has not changed (changed_documents: its ids); any other match is
    a move.  What is left over is deleted or added.

    Both states are shuffled once, by (document, hash); every window and
    grouping below works on keys that contain these two.
    """
    side = lambda df, name: df.select("document_id", "chunk_hash", *_FIELDS, F.lit(name).alias("side"))
    rows = side(old, "old").unionByName(side(new, "new")).repartition("document_id", "chunk_hash")
    exact = ["document_id", "chunk_hash", "start_offset", "end_offset"]
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*exact, "side").orderBy("position")))
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    both = rows.groupBy(*exact, "rn").agg(*[of(s, c) for s in ("old", "new") for c in ("position", "token_count", "metadata")])
    found = F.col("old_position").isNotNull() & F.col("new_position").isNotNull()
    same = found & F.col("old_token_count").eqNullSafe(F.col("new_token_count")) & F.col("old_metadata").eqNullSafe(F.col("new_metadata"))
    if changed_documents is not None:
        both = both.join(changed_documents.select("document_id").distinct().withColumn("changed", F.lit(True)), "document_id", "left")
        same &= F.col("changed").isNull()
    state = F.when(same, "keep").when(found, "move").when(F.col("new_position").isNull(), "old").otherwise("new")
    both = both.withColumn("state", state).withColumn("exact", found)
    left = Window.partitionBy("document_id", "chunk_hash", "state").orderBy(F.coalesce("old_position", "new_position"))
    columns = ("old_position", "new_position", "old_token_count", "new_token_count")
    merged = both.withColumn("rn", F.row_number().over(left)).groupBy("document_id", "chunk_hash", F.when(F.col("exact"), F.col("state")).otherwise("rest").alias("state"), "rn").agg(*[F.max(c).alias(c) for c in columns])
    kind = F.when(F.col("state") != "rest", F.col("state")).when(F.col("new_position").isNull(), "delete").when(F.col("old_position").isNull(), "add").otherwise("move")
    return merged.select("document_id", kind.alias("kind"), "chunk_hash", *columns)


def presented(operations: DataFrame) -> DataFrame:
    """Operations in the order a report shows: keep, move, add, delete, then by positions and hash."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return operations.orderBy("document_id", order, F.col("new_position").asc_nulls_last(), F.col("old_position").asc_nulls_last(), "chunk_hash")


def numbered(operations: DataFrame) -> DataFrame:
    """operations with their line, 1, 2, ..., in that order within each document."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return operations.withColumn("line", F.row_number().over(Window.partitionBy("document_id").orderBy(order, F.col("new_position").asc_nulls_last(), F.col("old_position").asc_nulls_last(), "chunk_hash")))


def counts(operations: DataFrame) -> DataFrame:
    """(kind, n) for all four kinds, 0 included."""
    kinds = operations.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(operations.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cost(operations: DataFrame, new: DataFrame, cached: DataFrame, usd_per_million: float | None = None, embed_all: bool = False) -> DataFrame:
    """One row: cache hits, chunks and tokens to embed, their price, and what embedding every changed document would take.

    Distinct added hashes (all hashes with embed_all) are probed in the cache
    once each; cached has a column chunk_hash.  An unknown price stays null.
    """
    wanted = new.select("chunk_hash", "token_count") if embed_all else operations.where("kind = 'add'").select("chunk_hash", F.col("new_token_count").alias("token_count"))
    wanted = wanted.groupBy("chunk_hash").agg(F.min("token_count").alias("token_count"))
    probe = wanted.join(cached.select("chunk_hash").distinct().withColumn("hit", F.lit(1)), "chunk_hash", "left")
    ours = probe.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("cache_hits"), F.count_if(F.col("hit").isNull()).alias("chunks_to_embed"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("token_count"))), F.lit(0)).alias("tokens_to_embed"))
    touched = new if embed_all else new.join(operations.where("kind <> 'keep'").select("document_id").distinct(), "document_id", "left_semi")
    naive = touched.agg(F.count("*").alias("naive_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("naive_tokens"))
    return ours.crossJoin(naive).select("*", price(F.col("tokens_to_embed"), usd_per_million).alias("estimated_cost"), price(F.col("naive_tokens"), usd_per_million).alias("naive_cost"), F.greatest(F.lit(0), F.col("naive_chunks") - F.col("chunks_to_embed")).alias("avoided_chunks"))


def churn(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Multiset comparison of chunk hashes: reused, added and removed chunks, tokens of the added, added over revised (0 without any).

    by: columns that tell corpora apart; each is compared on its own.
    """
    by = by or []
    a = old.groupBy(*by, "chunk_hash").agg(F.count("*").alias("n_old"))
    b = new.groupBy(*by, "chunk_hash").agg(F.count("*").alias("n_new"), F.min("token_count").alias("tokens"))
    both = a.join(b, [*by, "chunk_hash"], "full_outer").fillna(0, ["n_old", "n_new", "tokens"])
    added, total = F.greatest(F.lit(0), F.col("n_new") - F.col("n_old")), F.sum("n_new")
    return both.groupBy(*by).agg(
        F.sum("n_old").alias("original_chunks"), total.alias("revised_chunks"), F.sum(F.least("n_old", "n_new")).alias("reused_chunks"), F.sum(added).alias("added_chunks"),
        F.sum(F.greatest(F.lit(0), F.col("n_old") - F.col("n_new"))).alias("removed_chunks"), F.sum(added * F.col("tokens")).alias("tokens_to_embed"),
        F.when(total == 0, 0.0).otherwise(F.sum(added) / total).alias("reembed_fraction"),
    )

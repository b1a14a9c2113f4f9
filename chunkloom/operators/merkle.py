"""Merkle roots of documents and of the corpus, and positional differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..shared import numbered, written

BLOCK = 12


def document_roots(chunks: DataFrame, documents: DataFrame | None = None, namespace: str = I.NAMESPACE) -> DataFrame:
    """(document_id, chunk_count, root_hash) over chunk hashes in the order of position; documents adds those without a chunk."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_hash"))), lambda x: x["chunk_hash"])
    out = chunks.groupBy("document_id").agg(ordered.alias("leaves"))
    if documents is not None:
        out = documents.select(F.col("document_id").cast("string")).distinct().join(out, "document_id", "left").withColumn("leaves", F.coalesce("leaves", F.array().cast("array<string>")))
    return out.select("document_id", F.size("leaves").cast("long").alias("chunk_count"), I.merkle_root_col(F.col("leaves"), namespace).alias("root_hash"))


def corpus_root(roots: DataFrame, namespace: str = I.NAMESPACE, block: int = BLOCK) -> DataFrame:
    """One row (document_count, corpus_root): the tree over (document_id, root_hash) in the order of ids.

    Leaves are numbered by a distributed sort and reduced in aligned blocks of
    2^block, whose subtrees are the nodes of the level above, until one block is
    left: no array ever holds more than a block.
    """
    pair = I.framed_col(I.domain("corpus-document", namespace), F.col("document_id"), F.col("root_hash"))
    level, count = numbered(roots.select("document_id", I.leaf(pair, namespace).alias("value")), ["document_id"])
    spark, left = roots.sparkSession, count
    if not count:
        return spark.createDataFrame([(0, I.empty_root(namespace))], "document_count long, corpus_root string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"])
    while left > 1 << block:
        level = written(level.groupBy(F.shiftright("row", block).alias("up")).agg(ordered.alias("v")).select(F.col("up").alias("row"), I.merkle_root_col(F.col("v"), namespace, hashed=True, levels=block).alias("value")), "merkle")
        left = -(-left // (1 << block))
    return level.agg(ordered.alias("v")).select(F.lit(count).cast("long").alias("document_count"), I.merkle_root_col(F.col("v"), namespace, hashed=True).alias("corpus_root"))


def differing_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, position) where the chunk hashes of the two states differ or only one has a chunk."""
    a, b = old.select("document_id", "position", F.col("chunk_hash").alias("old_hash")), new.select("document_id", "position", F.col("chunk_hash").alias("new_hash"))
    return a.join(b, ["document_id", "position"], "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("document_id", "position")

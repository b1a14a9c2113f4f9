"""Exact duplicates by deterministic naming of blocks (operator 6).

Each text is cut into blocks of a fixed number of characters.  All blocks of
the corpus are sorted, and equal blocks get the same integer name.  Then
adjacent names are paired, the pairs are sorted and named in the same way, and
so on until each text has one name.  Two texts have the same (level, name) if
and only if they are equal: names come from comparing the values themselves,
there is no hash that could collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import Scratch, drop_rows, fresh, global_order

BLOCK_CHARS = 2048


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, uid, level, name): the collision-free identity of each text that is not null.

    uid tells rows of docs apart, so repeated doc_ids are no problem; a null
    doc_id is carried along.  An empty text is one empty block.  A text of n
    blocks is done after ceil(log2(n)) levels, so very long texts only add
    levels, and each level handles only the texts not yet done.
    """
    scratch = Scratch(docs.sparkSession, "names")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL").withColumn("uid", F.monotonically_increasing_id())
    blocks = F.greatest(F.lit(1), F.ceil(F.length("_text") / block_chars)).cast("int")
    rows = rows.select("doc_id", "uid", blocks.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring(F.col("_text"), i * block_chars + 1, F.lit(block_chars)))).alias("pos", "block"))
    named, count, _ = global_order(scratch, rows, ["block"], "level0", ["uid", "doc_id", "n", "pos"], by_hash=True)
    done = named.where("n = 1").select("doc_id", "uid", F.lit(0).alias("level"), "name")
    level, longest = 0, named.where("n > 1").agg(F.max("n")).collect()[0][0] or 1
    now = named
    while longest > 1:
        level += 1
        pairs = now.where("n > 1").groupBy("uid", "doc_id", "n", (F.col("pos") / 2).cast("int").alias("half")).agg(F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = pairs.select("uid", "doc_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "left", "right")
        now, _, _ = global_order(scratch, pairs, ["left", "right"], f"level{level}", ["uid", "doc_id", "n", "pos"])
        done = done.unionByName(now.where("n = 1").select("doc_id", "uid", F.lit(level).alias("level"), "name"))
        longest = -(-longest // 2)
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, canonical_id, n_copies, is_duplicate), one for each row of docs.

    canonical_id is the least doc_id among the rows of equal text and n_copies
    their number; of equal texts one row is no duplicate, the one of the least
    doc_id (of repeated doc_ids, one).  A row whose text is null equals no
    other: its canonical_id is its own, n_copies 1.  Null doc_ids come last
    among equals.  Further columns of docs are not looked at.
    """
    named = identities(docs, id_col, text_col, block_chars)
    groups = named.groupBy("level", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("uid"))).alias("first"), F.count("*").alias("n_copies"))
    out = named.join(groups, ["level", "name"]).select("doc_id", F.col("first.doc_id").alias("canonical_id"), F.col("n_copies").cast("long"), (F.col("uid") != F.col("first.uid")).alias("is_duplicate"))
    null = docs.where(F.col(text_col).isNull()).select(F.col(id_col).alias("doc_id"), F.col(id_col).alias("canonical_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(False).alias("is_duplicate"))
    return out.unionByName(null)


def keep_first(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with one row of each text, that of the least doc_id; rows of a null text all stay.

    Copies are dropped by doc_id.  Where the doc_id of a dropped row also has
    a row that stays (repeated rows, or an id with several texts), and for null ids, the
    decision is made on (doc_id, text) instead, so that one row of each text is left.
    """
    decided = Scratch(docs.sparkSession, "first").table(exact_duplicates(docs, block_chars=block_chars), "decided")
    ids = decided.groupBy("doc_id").agg(F.max("is_duplicate").alias("some"), F.min("is_duplicate").alias("all")).where("some")
    name = fresh(docs, "_id")
    mixed = ids.where("NOT all OR doc_id IS NULL").select(F.col("doc_id").alias(name))
    if mixed.limit(1).count() == 0:
        return drop_rows(docs, ids)
    kept = drop_rows(docs, ids).where("doc_id IS NOT NULL")
    if mixed.where(F.col(name).isNull()).count() == 0:
        kept = kept.unionByName(docs.where("doc_id IS NULL"))
    rows = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
    one = rows.where("text IS NOT NULL").groupBy("text").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("r")).select("r.*")
    # a text whose first row has an id of its own is in kept already
    elsewhere = kept.where("text IS NOT NULL").select(F.col("text").alias(name))
    return kept.unionByName(one.join(elsewhere, F.col("text") == F.col(name), "left_anti")).unionByName(rows.where("text IS NULL"))


SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS canonical_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_copies,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 AS is_duplicate
FROM documents
"""

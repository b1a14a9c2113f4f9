"""Shared folders, materialised tables, global order and connected components.

Nothing is kept in executor memory between jobs: what a later job needs is
written as Parquet below ``spark.checkpoint.dir``, which all executors share,
so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import shared_dir
from ._text import column

class Scratch:
    """Tables of one operator run; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes df and returns the table as read again: its lineage is the files."""
        df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        jvm = self.spark._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class _Collision(Exception):
    """Different keys of the same hash lie on both sides of a partition border."""


def global_order(scratch: Scratch, df: DataFrame, keys: list[str], tag: str, keep: list[str], by_hash: bool = False) -> tuple[DataFrame, int, int]:
    """Sorts df by keys over the whole cluster and numbers the rows.

    Returns a table of the columns ``keep`` with ``row`` (0, 1, ... in the order of
    keys) and ``name`` (rank of the keys' values among the distinct ones: equal
    keys, and only those, get equal names), the number of rows and that of names.

    Rows are range-partitioned by keys and the remaining kept columns, so a value
    that occurs very often spreads over several partitions; names are joined up
    at partition borders by comparing the values themselves.  The sorted rows are
    numbered as they stream by and written once without the key values; what
    goes through the driver is four values for each partition.

    by_hash: keys are long, so the order is that of (hash of keys, keys) and
    ranges are cut by hash, which keeps the sampled range bounds short.  Values
    are still compared as they are; should different values of one hash meet at
    a border, the ranges are cut by the keys after all.
    """
    try:
        return _ordered(scratch, df, keys, tag, keep, by_hash)
    except _Collision:
        return _ordered(scratch, df, keys, f"{tag}-keys", keep, False)


def _ordered(scratch: Scratch, df: DataFrame, keys: list[str], tag: str, keep: list[str], by_hash: bool) -> tuple[DataFrame, int, int]:
    ties = [c for c in keep if c not in keys]
    rows = df.select(*dict.fromkeys([*keys, *keep])).withColumn("_h", F.xxhash64(*keys) if by_hash else F.lit(0).cast("long"))
    cut = ["_h"] if by_hash else keys
    ordered = rows.repartitionByRange(*[F.col(c) for c in [*cut, *ties]]).sortWithinPartitions("_h", *keys, *ties)
    kept = [T.StructField(f.name, f.dataType) for f in ordered.schema.fields if f.name in keep]
    key_fields = [T.StructField(k, ordered.schema[k].dataType) for k in keys]
    schema = T.StructType([*kept, T.StructField("_pid", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_name", T.LongType()), T.StructField("_edge", T.ArrayType(T.StructType([T.StructField("_h", T.LongType()), *key_fields])))])
    want = to_arrow_schema(schema)
    edge_type = want.field("_edge").type

    def pack(cols, pid, row, name, edge):
        cols = [*cols, np.full(len(row), pid, np.int32), row, name]
        cols = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, want)]
        return pa.RecordBatch.from_arrays([*cols, edge], schema=want)

    def number(batches):
        from pyspark import TaskContext

        pid, row, rank, last = TaskContext.get().partitionId(), 0, -1, None
        first = first_end = last_begin = None  # the least key, the greatest of its hash, the least of the last hash
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [column(batch, k) for k in ["_h", *keys]]
            value = lambda i, cols=cols: [c[i].as_py() for c in cols]
            change = np.zeros(n, bool)
            head = value(0)
            change[0] = last is None or head != last
            for c in cols:
                change[1:] |= differs(c)
            h = cols[0].to_numpy()
            begin = int(np.searchsorted(h, h[-1]))
            if first is None:
                first = head
            if h[0] == first[0]:
                first_end = value(int(np.searchsorted(h, h[0], "right")) - 1)
            if begin or last is None or h[0] != last[0]:
                last_begin = value(begin)
            last = value(n - 1)
            name = rank + np.cumsum(change, dtype=np.int64)
            rank = int(name[-1])
            yield pack([column(batch, f.name) for f in kept], pid, np.arange(row, row + n, dtype=np.int64), name, pa.nulls(n, edge_type))
            row += n
        if row:
            edge = pa.array([[dict(zip(["_h", *keys], e)) for e in (first, first_end, last_begin, last)]], edge_type)
            yield pack([pa.nulls(1, want.field(f.name).type) for f in kept], pid, np.array([row]), np.array([rank + 1]), edge)

    table = scratch.table(ordered.mapInArrow(number, schema), tag)
    parts = sorted(table.where("_edge IS NOT NULL").select("_pid", "_row", "_name", "_edge").collect(), key=lambda r: r._pid)
    total = names = 0
    before, shift = None, []
    for p in parts:
        if by_hash and before is not None and before[3]._h == p._edge[0]._h and not before[2] == before[3] == p._edge[0] == p._edge[1]:
            raise _Collision
        same = before is not None and before[3] == p._edge[0]
        names -= same
        shift.append((p._pid, total, names))
        total, names, before = total + p._row, names + p._name, p._edge
    offsets = scratch.spark.createDataFrame(shift or [(0, 0, 0)], "_pid int, _r long, _n long")
    numbered = table.where("_edge IS NULL").join(F.broadcast(offsets), "_pid")
    return numbered.select(*keep, (F.col("_row") + F.col("_r")).alias("row"), (F.col("_name") + F.col("_n")).alias("name")), total, names


def differs(c: pa.Array) -> np.ndarray:
    """For each value but the first, whether it differs from the one before; nulls are equal to nulls."""
    if len(c) < 2:
        return np.zeros(0, bool)
    if not c.null_count:
        return pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    null = c.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of the undirected graph of edges (a, b): rows (id, comp), comp the least id.

    Labels go to the least label among the neighbours', then to the label of
    that label, until nothing changes: a logarithmic number of rounds on long
    chains, two or three on groups of copies.  Each round's labels are a table.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), f"{tag}-0")
    k = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        step = step.join(jump, "comp").select("id", "old", F.least("comp", "root").alias("comp"))
        k += 1
        now = scratch.table(step, f"{tag}-{k}")
        changed = now.where("old <> comp").limit(1).count()
        scratch.drop(f"{tag}-{k - 1}")
        labels = now.select("id", "comp")
        if not changed:
            scratch.drop(f"{tag}-edges")
            return labels


def bytes_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as tell it from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_rows(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ``drop``; a null id is never dropped.

    The ids grow with the corpus, so they are never broadcast: both sides meet in one shuffle by id.
    """
    name = fresh(docs, "_drop")
    return docs.join(drop.select(F.col(id_col).alias(name)).distinct().hint("merge"), F.col(id_col) == F.col(name), "left_anti")

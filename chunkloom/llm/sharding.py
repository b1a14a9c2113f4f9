"""Range sharding by sampled splitters (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._dist import Scratch, fresh

SHARD_BYTES = 128 << 20
LEAST = 16
OVERSAMPLE = 32
TOLERANCE = 1.5
WIDE = 512


def shards(docs: DataFrame, key: str = "source", id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, least: int = LEAST, oversample: int = OVERSAMPLE, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with a column ``shard``, physically partitioned by it and sorted by (key, id).

    Shards are consecutive ranges of (key, id), nulls first, of about shard_bytes of text, or a ``least``-th of all
    text where that is less, so that a small table is spread as well: 1) rows are drawn with a probability in
    proportion to their size, about ``oversample`` for each shard; 2) quantiles of the sample
    are the splitters; 3) the exact size of every range is counted, and a range
    above tolerance x the shard's size is subdivided at quantiles of a sample drawn
    inside it, until it fits or holds a single (key, id).  The repeated rows of
    an overfull single (key, id) are dealt out to several shards by a hash of
    the row.

    The sample is sorted and summed up by the cluster; the driver gets the splitters, one short key a shard, and one number
    a range (800,000 of each for 100 TB).  Every row gets into exactly one
    shard; an empty table gives no rows.  A column of docs called ``shard``
    is replaced.  A row counts as one byte more than its
    text, a null text as one.  Texts are never cut: one above a shard's size makes
    a larger shard.
    """
    docs = docs.drop("shard")
    name = fresh(docs, "_key")
    docs = docs.withColumn(name, order_key(docs, key, id_col))
    scratch = Scratch(docs.sparkSession, "sharding")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    slim = docs.select(F.col(name).alias("_key"), size.alias("w"), F.xxhash64(name, text_col).alias("h"))
    (total,) = slim.agg(F.sum("w")).collect()[0]
    if not total:
        return docs.drop(name).withColumn("shard", F.lit(0))
    shard_bytes = max(1, min(shard_bytes, -(-total // least)))
    splitters = _splitters(scratch, slim.select(F.lit(0).alias("r"), "_key", "w", "h"), {0: total}, shard_bytes, oversample)
    while True:
        ranges = slim.select(_range_of(splitters)(F.col("_key")).alias("r"), "_key", "w").groupBy("r").agg(F.sum("w").alias("w"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        full = ranges.where(F.col("w") > tolerance * shard_bytes).collect()
        deal = {x.r: -(-x.w // shard_bytes) for x in full if x.low == x.high}
        split = {x.r: x for x in full if x.low != x.high}
        if not split:
            break
        inside = slim.select(_range_of(splitters)(F.col("_key")).alias("r"), "_key", "w", "h").where(_member(split)("r"))
        drawn = _splitters(scratch, inside, {r: x.w for r, x in split.items()}, shard_bytes, oversample)
        # the greatest key of a range divides nothing, and the least one always does
        highest = {x.high for x in split.values()}
        found = set(drawn) - highest
        at = np.searchsorted(np.array(splitters or [b""], dtype=object), np.array(sorted(found), dtype=object)) if found else []
        divided = set(np.asarray(at, np.int64).tolist()) if splitters else ({0} if found else set())
        found |= {x.low for r, x in split.items() if r not in divided}
        splitters = sorted({*splitters, *found})
    parts = np.ones(len(splitters) + 1, np.int64)
    for r, n in deal.items():
        parts[r] = n
    begin = np.concatenate([[0], np.cumsum(parts)])
    out = docs.withColumn("shard", _shard_of(splitters, begin[:-1], parts)(F.col(name), F.xxhash64(text_col, F.monotonically_increasing_id())))
    return out.repartitionById(int(begin[-1]), F.col("shard")).sortWithinPartitions("shard", name).drop(name)


def order_key(docs: DataFrame, key: str, id_col: str) -> Column:
    """Hexadecimal digits that sort as (key, id) do, nulls first."""

    def part(name: str) -> Column:
        if isinstance(docs.schema[name].dataType, T.IntegralType):
            value = F.unhex(F.lpad(F.hex(F.col(name).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
        else:
            value = F.encode(F.col(name).cast("string"), "UTF-8")
        return F.coalesce(F.concat(F.lit(b"\x01"), value), F.lit(b"\x00"))

    return F.hex(F.concat(part(key), F.lit(b"\x00"), part(id_col)))


def _splitters(scratch: Scratch, rows: DataFrame, weight: dict[int, int], shard_bytes: int, oversample: int) -> list[str]:
    """Quantiles of each range r of rows (r, _key, w, h): enough keys, sorted, to cut it into parts of about shard_bytes.

    Each row is drawn with probability min(1, w x oversample / shard_bytes), by a hash of the row, the same on every run, and
    stands for the weight it would have had on average.  The drawn rows are range-partitioned and summed as they
    stream by; a row becomes a splitter where the sum passes a multiple of the part's weight.
    """
    share = F.col("w") * (oversample / shard_bytes)
    u = F.pmod(F.xxhash64("h", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(u < share).select("r", "_key", F.greatest(F.lit(1.0), share).alias("m"))
    tag = f"drawn-{len(weight)}-{sum(weight.values())}"
    drawn = scratch.table(drawn.repartitionByRange("r", "_key").sortWithinPartitions("r", "_key").withColumn("p", F.spark_partition_id()), tag)
    sums = sorted((x.r, x.p, x.m) for x in drawn.groupBy("r", "p").agg(F.sum("m").alias("m")).collect())
    total: dict[int, float] = {}
    before = {}
    for r, p, m in sums:
        before[(r, p)] = total.get(r, 0.0)
        total[r] = before[(r, p)] + m
    step = {r: t / max(1, -(-weight[r] // shard_bytes)) for r, t in total.items()}
    if not step:
        return []
    base = drawn.sparkSession.createDataFrame([(r, p, b, step[r], total[r]) for (r, p), b in before.items()], "r int, p int, before double, step double, total double")
    # within a file the rows are sorted, and a running sum in the order of keys is that of the partition
    from pyspark.sql import Window

    running = drawn.join(F.broadcast(base), ["r", "p"]).withColumn("sum", F.col("before") + F.sum("m").over(Window.partitionBy("r", "p").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)))
    passes = F.floor(F.col("sum") / F.col("step") + 1e-9) > F.floor((F.col("sum") - F.col("m")) / F.col("step") + 1e-9)
    return sorted({x[0] for x in running.where(passes & (F.col("sum") < F.col("total") - 1e-9)).select("_key").collect()})


def _places(splitters: list[str]):
    """A function from keys to the number of splitters below each, so that a splitter closes its range."""
    width = max([1, *map(len, splitters)])
    fixed = np.array([s.encode() for s in splitters], f"S{max(width, 1)}")

    def places(key: pa.Array) -> np.ndarray:
        if not len(key) or not splitters:
            return np.zeros(len(key), np.int64)
        # digits of a key beyond the longest splitter only tell that it is greater
        most = max(width + 1, 1)
        cut = pc.utf8_slice_codeunits(key, 0, most)
        padded = pc.ascii_rpad(cut, most, "\0")
        data = np.frombuffer(padded.buffers()[2], np.uint8)[: most * len(key)] if padded.offset == 0 else np.frombuffer("".join(padded.to_pylist()).encode(), np.uint8)
        return np.searchsorted(fixed.astype(f"S{most}"), data.view(f"S{most}"))

    return places


def _range_of(splitters: list[str]):
    @F.arrow_udf(T.IntegerType())
    def find(key: pa.Array) -> pa.Array:
        return pa.array(_places(splitters)(key).astype(np.int32))

    return find


def _member(ranges: dict):
    wanted = np.array(sorted(ranges))

    @F.arrow_udf(T.BooleanType())
    def member(r: pa.Array) -> pa.Array:
        return pa.array(np.isin(r.to_numpy(zero_copy_only=False), wanted))

    return member


def _shard_of(splitters: list[str], begin: np.ndarray, parts: np.ndarray):
    @F.arrow_udf(T.IntegerType())
    def number(key: pa.Array, h: pa.Array) -> pa.Array:
        at = _places(splitters)(key)
        return pa.array((begin[at] + h.to_numpy(zero_copy_only=False) % parts[at]).astype(np.int32))

    return number


def held(docs: DataFrame, **how) -> DataFrame:
    """Rows (source, docs, shards_disjoint, sizes_bounded) of each source of docs once sharded.

    shards_disjoint: no shard that holds the source overlaps another one's range of (key, id), but for a single
    (key, id) that was dealt out; sizes_bounded: none of them is above 1.5 times the shard's size, but for a single text.
    """
    out = shards(docs, **how).withColumn("_w", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    rows = out.select("source", "shard", "_w", order_key(out, "source", "doc_id").alias("k"))
    each = rows.groupBy("shard").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.sum("_w").alias("size"), F.max("_w").alias("largest"))
    from pyspark.sql import Window

    total = out.agg(F.sum("_w")).collect()[0][0] or 0
    bound = TOLERANCE * max(1, min(how.get("shard_bytes", SHARD_BYTES), -(-total // how.get("least", LEAST))))
    # one row a shard
    order = Window.orderBy("shard")
    each = each.withColumn("ok", F.coalesce(F.lag("high").over(order) < F.col("low"), F.lit(True)) | (F.lag("high").over(order).eqNullSafe(F.col("low")) & (F.col("low") == F.col("high")))).withColumn("fits", (F.col("size") <= bound) | (F.col("size") <= F.col("largest") * TOLERANCE))
    return rows.join(F.broadcast(each.select("shard", "ok", "fits")), "shard").groupBy("source").agg(F.count("*").alias("docs"), F.bool_and("ok").alias("shards_disjoint"), F.bool_and("fits").alias("sizes_bounded"))


#: Of held.
SQL = "SELECT source, count(*) AS docs, true AS shards_disjoint, true AS sizes_bounded FROM documents GROUP BY source"

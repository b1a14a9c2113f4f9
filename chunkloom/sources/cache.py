"""The embedding cache: a Parquet table keyed by (chunk_hash, model_id, params_hash).

Entries and touches are only ever appended; a prune writes what it keeps into a new folder, which takes effect when a commit
file names it, so a crash loses nothing.  The time of an entry's last use is the latest of its own and its touches.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackendError
from ..functions.scoring import MAX_DIMENSIONS, valid_vector
from ..shared import numbered

IMPORT_BYTES, IMPORT_LINE = 512 << 20, 4 << 20
KEY = ["chunk_hash", "model_id", "params_hash"]
ENTRIES = "chunk_hash string, model_id string, params_hash string, dimensions int, vector array<float>, token_count int, created_at timestamp, accessed_at timestamp"
TOUCHES = "chunk_hash string, model_id string, params_hash string, accessed_at timestamp"


def stats(entries: DataFrame) -> DataFrame:
    """One row: entries, chunks, models, bytes (4 a value)."""
    return entries.agg(F.count("*").alias("entries"), F.countDistinct("chunk_hash").alias("chunks"), F.countDistinct(F.concat_ws(":", "model_id", "params_hash")).alias("models"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).cast("long").alias("bytes"))


def pruned(entries: DataFrame, older_than: Column | None = None, max_entries: int | None = None) -> DataFrame:
    """What a prune keeps: first those used at or after older_than, then the most recently used ones."""
    if older_than is None and max_entries is None:
        raise ValueError("a prune needs an age or a number of entries")
    kept = entries if older_than is None else entries.where(F.col("accessed_at") >= older_than)
    if max_entries is None:
        return kept
    # numbered by a distributed sort, ties by key: no task holds more than its range
    order = kept.withColumn("_age", -F.unix_micros("accessed_at"))
    return numbered(order, ["_age", *KEY], "_row")[0].where(F.col("_row") < max_entries).drop("_age", "_row")


class EmbeddingCache:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folder(self) -> str:
        """That of the latest commit; the cache's own one before there is any."""
        fs, p = self._fs(f"{self.root}/commits")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return f"{self.root}/{names[-1]}" if names else self.root

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self._folder()}/{name}"
        fs, p = self._fs(path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def get(self, chunk_hash: str, model_id: str, params_hash: str) -> list[float] | None:
        """The vector of one entry, or None; the key is pushed down to the files."""
        found = self.vectors(model_id, params_hash).where(F.col("chunk_hash") == chunk_hash).limit(1).collect()
        return list(found[0].vector) if found else None

    def entries(self) -> DataFrame:
        last = self._table("touches", TOUCHES).groupBy(*KEY).agg(F.max("accessed_at").alias("touched"))
        e = self._table("entries", ENTRIES)
        return e.join(last, KEY, "left").withColumn("accessed_at", F.greatest("accessed_at", F.coalesce("touched", "accessed_at"))).drop("touched")

    def vectors(self, model_id: str, params_hash: str) -> DataFrame:
        return self._table("entries", ENTRIES).where((F.col("model_id") == model_id) & (F.col("params_hash") == params_hash)).select("chunk_hash", "vector")

    def touch(self, hashes: DataFrame, model_id: str, params_hash: str) -> None:
        keys = hashes.select("chunk_hash").distinct().select("chunk_hash", F.lit(model_id).alias("model_id"), F.lit(params_hash).alias("params_hash"), F.lit(datetime.now(timezone.utc)).alias("accessed_at"))
        keys.write.mode("append").parquet(f"{self._folder()}/touches")

    def put(self, rows: DataFrame, model_id: str, params_hash: str, dimensions: int) -> None:
        """Adds (chunk_hash, vector, token_count); the same entry again is nothing new, another vector under its key an error."""
        if not 0 < dimensions <= MAX_DIMENSIONS:
            raise ValueError("dimensions out of range")
        now = F.lit(datetime.now(timezone.utc))
        fine = valid_vector(F.col("vector")) & (F.size("vector") == dimensions)
        from ..shared import written

        new = written(rows.select("chunk_hash", F.lit(model_id).alias("model_id"), F.lit(params_hash).alias("params_hash"), F.lit(dimensions).alias("dimensions"), F.when(fine, F.col("vector")).otherwise(F.raise_error(F.lit("a vector is invalid")).cast("array<float>")).alias("vector"), F.col("token_count").cast("int"), now.alias("created_at"), now.alias("accessed_at")), "put")
        old = self._table("entries", ENTRIES)
        clash = new.alias("n").join(old.alias("o"), KEY).where(~F.col("n.vector").eqNullSafe(F.col("o.vector")) | (F.col("n.token_count") != F.col("o.token_count"))).limit(1).count()
        if clash or new.groupBy(*KEY).agg(F.countDistinct("vector").alias("n")).where("n > 1").limit(1).count():
            raise BackendError("a cache key comes with another payload")
        new.dropDuplicates(KEY).join(old.select(*KEY), KEY, "left_anti").select(*[c.split()[0] for c in ENTRIES.split(", ")]).write.mode("append").parquet(f"{self._folder()}/entries")

    def stats(self) -> dict[str, int]:
        return stats(self.entries()).collect()[0].asDict()

    def prune(self, older_than: datetime | None = None, max_entries: int | None = None) -> int:
        """Removes entries; how many."""
        from ..shared import written

        all_ = self.entries()
        kept = written(pruned(all_, None if older_than is None else F.lit(older_than), max_entries), "prune")
        gone = all_.count() - kept.count()
        if gone:
            self._replace(kept)
        return gone

    def _replace(self, kept: DataFrame) -> None:
        before = self._folder()
        name = f"{int(before.rsplit('/g', 1)[1][:8]) + 1 if before != self.root else 1:08d}"
        folder = f"g{name}-{uuid.uuid4().hex[:8]}"
        kept.select(*[c.split()[0] for c in ENTRIES.split(", ")]).write.parquet(f"{self.root}/{folder}/entries")
        fs, p = self._fs(f"{self.root}/commits/{folder}")
        fs.create(p, False).close()
        for old in [f"{self.root}/entries", f"{self.root}/touches"] if before == self.root else [before]:  # no longer read
            fs, p = self._fs(old)
            fs.delete(p, True)

    def export_jsonl(self, path: str, force: bool = False) -> None:
        """Entries in the order of their keys as JSON lines, a folder of files whose names sort in that order."""
        self.entries().orderBy(*KEY).write.mode("overwrite" if force else "errorifexists").json(path)

    def import_jsonl(self, path: str, trusted: bool = False) -> int:
        """Adds exported entries; vectors decide what queries find, so the caller must say that the file is trusted.

        Files of more than IMPORT_BYTES in all, and lines of more than IMPORT_LINE, are refused before anything is parsed.
        """
        if not trusted:
            raise BackendError("an import needs trusted=True")
        fs, p = self._fs(path)
        if fs.getContentSummary(p).getLength() > IMPORT_BYTES:
            raise BackendError(f"the import has more than {IMPORT_BYTES} bytes")
        if (self.spark.read.text(path).agg(F.max(F.octet_length("value"))).collect()[0][0] or 0) > IMPORT_LINE:
            raise BackendError(f"the import has a line of more than {IMPORT_LINE} bytes")
        rows = self.spark.read.schema(ENTRIES).option("mode", "FAILFAST").json(path).where("chunk_hash IS NOT NULL")
        n = 0
        for r in rows.groupBy("model_id", "params_hash", "dimensions").count().collect():
            part = rows.where((F.col("model_id") == r.model_id) & (F.col("params_hash") == r.params_hash) & (F.col("dimensions") == r.dimensions))
            self.put(part, r.model_id, r.params_hash, r.dimensions)
            n += r["count"]
        return n



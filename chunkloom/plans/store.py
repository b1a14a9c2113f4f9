"""Versioned index generations on Parquet, written as deltas.

A generation adds one folder with four tables: ``rows``, new or changed chunk rows; ``gone``, the rows of earlier folders that are
tombstoned or superseded; ``documents`` and ``manifests``, those that changed or were deleted.  Its commit file, created exclusively, lists
the folders it consists of: of two writers of the same generation one fails, nothing that is committed is ever changed, and a
change of one document writes bytes in proportion to that document.  ``compact`` merges the folders into one, ``vacuum`` deletes those that no recent commit lists.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BackendError, StaleError
from ..functions import identity, scoring
from ..shared import written
from . import manifest as mf

MERGE_AT = 64  # folders

CHUNKS = (
    "instance_id string, document_id string, position int, chunk_hash string, text string, start_offset int, end_offset int, token_count int, boundary_kind string,"
    " vector array<float>, dimensions int, model_id string, params_hash string, metadata string, chunker_id string, chunker_params_hash string,"
    " record_digest string, valid_from timestamp, valid_to timestamp, is_active boolean"
)
DOCUMENTS = "document_id string, root_hash string, chunk_count long, hard_cuts long, metadata string"
_NAMES = [c.strip().split()[0] for c in CHUNKS.split(",")]
_OWN = [n for n in _NAMES if n not in ("valid_to", "is_active")]
ROWS = ", ".join(c for c in CHUNKS.split(", ") if c.split()[0] in _OWN) + ", generation int"
GONE = "instance_id string, generation int, valid_to timestamp"  # no time: another row of the same instance took its place
TABLES = {"rows": ROWS, "gone": GONE, "documents": DOCUMENTS + ", generation int, deleted boolean", "manifests": mf.MANIFEST + ", generation int, deleted boolean"}
FORMAT = 2


@F.arrow_udf(T.BinaryType())
def float_bytes(vector: pa.Array) -> pa.Array:
    """The values of each vector as 32-bit floats, little-endian, one after the other; an empty one for null."""
    flat = vector.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(vector.value_lengths(), 0).to_numpy(zero_copy_only=False))]) * 4
    return pa.Array.from_buffers(pa.binary(), len(vector), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def record_digest(c: Any = F.col, namespace: str = identity.NAMESPACE) -> Column:
    """Commits to every durable field of a row, the vector's bytes included; when it became valid, or ceased to be, is no part of it."""
    text = [F.coalesce(c(n).cast("string"), F.lit("")) for n in _OWN if n not in ("vector", "record_digest", "valid_from")]
    return identity.framed_col(identity.domain("index-record", namespace), *text, float_bytes(c("vector")))


def merge_snapshot(current: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """The next generation's chunks: desired rows active, other active rows tombstoned at ``now``, tombstones kept.

    Both sides meet in one full outer join on instance_id.  A row that stays
    keeps its valid_from.  The task fails if a desired id is a tombstone's, or
    an id comes with another hash, text or vector than before.
    """
    fields = [n for n in _NAMES if n not in ("valid_from", "valid_to", "is_active")]
    both = current.alias("o").join(desired.alias("n"), F.col("o.instance_id") == F.col("n.instance_id"), "full_outer")
    mine, theirs = F.col("n.instance_id").isNotNull(), F.col("o.instance_id").isNotNull()
    differs = ~(F.col("o.chunk_hash").eqNullSafe(F.col("n.chunk_hash")) & F.col("o.text").eqNullSafe(F.col("n.text")) & F.col("o.vector").eqNullSafe(F.col("n.vector")) & F.col("o.model_id").eqNullSafe(F.col("n.model_id")))
    bad = F.when(mine & F.col("o.valid_to").isNotNull(), F.raise_error(F.lit("a tombstoned instance would become active again"))).when(mine & theirs & differs, F.raise_error(F.lit("an instance id has another content than before"))).otherwise(F.coalesce(F.col("n.instance_id"), F.col("o.instance_id")))
    out = [bad.alias("instance_id") if n == "instance_id" else F.when(mine, F.col(f"n.{n}")).otherwise(F.col(f"o.{n}")).alias(n) for n in fields]
    valid_to = F.when(mine, F.lit(None)).otherwise(F.coalesce(F.col("o.valid_to"), now)).cast("timestamp")
    return both.select(*out, F.coalesce(F.col("o.valid_from"), now).alias("valid_from"), valid_to.alias("valid_to")).withColumn("is_active", F.col("valid_to").isNull())


def eligible(chunks: DataFrame, cutoff: Column) -> DataFrame:
    """Tombstones at or before the cutoff."""
    return chunks.where(F.col("valid_to").isNotNull() & (F.col("valid_to") <= cutoff))


def status(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, active, tombstoned, hard_cuts, total_boundaries, hard_cut_rate."""
    rows = chunks.agg(F.count_if(F.col("valid_to").isNull()).alias("active"), F.count_if(F.col("valid_to").isNotNull()).alias("tombstoned"))
    docs = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("hard_cuts"), F.lit(0)).alias("hard_cuts"), F.coalesce(F.sum(F.greatest(F.col("chunk_count") - 1, F.lit(0))), F.lit(0)).alias("total_boundaries"))
    return docs.crossJoin(rows).withColumn("hard_cut_rate", F.when(F.col("total_boundaries") == 0, 0.0).otherwise(F.col("hard_cuts") / F.col("total_boundaries")))


def check_records(desired: DataFrame, dimensions: int) -> DataFrame:
    """desired, failing on a duplicate instance or position, or a vector that isn't valid."""
    twice = desired.groupBy("instance_id").count().where("count > 1").select(F.lit("instance id").alias("what")).union(desired.groupBy("document_id", "position").count().where("count > 1").select(F.lit("position").alias("what"))).limit(1).collect()
    if twice:
        raise BackendError(f"a snapshot has the same {twice[0][0]} twice")
    fine = scoring.valid_vector(F.col("vector")) & (F.size("vector") == dimensions)
    return desired.withColumn("vector", F.when(fine, F.col("vector")).otherwise(F.raise_error(F.lit("a vector is invalid or of other dimensions")).cast("array<float>")))


@dataclass(frozen=True)
class State:
    """What a commit file says."""

    generation: int = 0
    corpus_root: str | None = None
    model_id: str | None = None
    params_hash: str | None = None
    dimensions: int | None = None
    folders: tuple[str, ...] = ()
    updated_at: str | None = None


def changes(now: DataFrame, desired: DataFrame, fields: list[str], generation: int) -> DataFrame:
    """Rows of desired that are new or not as before, and deleted ones of now that desired lacks; keyed by document_id."""
    value = lambda df, name: df.select("document_id", F.struct(*fields).alias(name))
    both = value(now, "o").join(value(desired, "n"), "document_id", "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select("document_id", *[F.coalesce(F.col("n"), F.col("o"))[f].alias(f) for f in fields if f != "document_id"], F.lit(generation).alias("generation"), F.col("n").isNull().alias("deleted"))


class IndexStore:
    """The index below one folder; a missing one is empty."""

    def __init__(self, spark: SparkSession, root: str, namespace: str = identity.NAMESPACE) -> None:
        self.spark, self.root, self.namespace = spark, root.rstrip("/"), namespace

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def _commit(self, name: str) -> State:
        value = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/commits/{name}", wholetext=True).collect()))
        if value.pop("format", None) != FORMAT:
            raise BackendError("the index has an unknown format")
        return State(**value | {"folders": tuple(value["folders"])})

    def state(self) -> State:
        names = self._commits()
        return self._commit(names[-1]) if names else State()

    def _read(self, table: str) -> DataFrame:
        folders = self.state().folders
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{f}/{table}" for f in folders])

    def _latest(self, table: str) -> DataFrame:
        rows, names = self._read(table), [n for n in _columns(TABLES[table]) if n != "document_id"]
        if len(self.state().folders) > 1:
            rows = rows.groupBy("document_id").agg(F.max_by(F.struct(*names), "generation").alias("r")).select("document_id", "r.*")
        return rows.where("NOT deleted").drop("generation", "deleted")

    def _current(self) -> DataFrame:
        """All rows that no other has superseded, with their generation."""
        gone = self._read("gone").withColumn("_gone", F.lit(True))
        rows = self._read("rows").join(gone, ["instance_id", "generation"], "left").where("_gone IS NULL OR valid_to IS NOT NULL")
        return rows.withColumn("is_active", F.col("valid_to").isNull())

    def chunks(self) -> DataFrame:
        return self._current().select(*_NAMES)

    def _active(self) -> DataFrame:
        return self._read("rows").join(self._read("gone").select("instance_id", "generation"), ["instance_id", "generation"], "left_anti")

    def active(self) -> DataFrame:
        return self._active().withColumns({"valid_to": F.lit(None).cast("timestamp"), "is_active": F.lit(True)}).select(*_NAMES)

    def documents(self) -> DataFrame:
        return self._latest("documents")

    def manifests(self) -> DataFrame:
        return self._latest("manifests")

    def status(self) -> dict[str, Any]:
        row = status(self.chunks(), self.documents()).collect()[0].asDict()
        s = self.state()
        return row | {"generation": s.generation, "corpus_root": s.corpus_root, "model_id": s.model_id, "params_hash": s.params_hash}

    def _publish(self, tables: dict[str, DataFrame], before: State, merged: bool = False, **facts: Any) -> State:
        """Writes generation before.generation + 1 and commits it, unless another writer came first; merged: the tables are the whole index."""
        folder = f"gen-{before.generation + 1:08d}-{uuid.uuid4().hex[:8]}"
        state = State(generation=before.generation + 1, folders=(*(() if merged else before.folders), folder), updated_at=datetime.now(timezone.utc).isoformat(timespec="microseconds"), **facts)
        for name, schema in TABLES.items():
            tables[name].select(*_columns(schema)).write.parquet(f"{self.root}/{folder}/{name}")
        try:
            if self.state() != before:
                raise StaleError("the index has changed since the plan was made")
            fs, p = self._fs(f"{self.root}/commits/{state.generation:08d}.json")
            try:
                out = fs.create(p, False)
            except Exception as e:
                raise StaleError("another writer has committed this generation") from e
            out.write(bytearray(json.dumps(state.__dict__ | {"format": FORMAT}, sort_keys=True).encode()))
            out.close()
        except StaleError:
            fs, p = self._fs(f"{self.root}/{folder}")
            fs.delete(p, True)
            raise
        return state

    def apply(self, desired: DataFrame, documents: DataFrame, manifests: DataFrame, before: State, corpus_root: str, model_id: str, params_hash: str, dimensions: int, scope: DataFrame | None = None) -> State:
        """Makes desired the active rows of all documents, or of those in scope (document_id); writes what differs only.

        The task fails if a desired id is a tombstone's, or an id comes with another hash, text or vector than before.
        """
        generation, now = before.generation + 1, F.lit(datetime.now(timezone.utc))
        desired = check_records(desired, dimensions).withColumn("record_digest", record_digest(F.col, self.namespace))
        inside = lambda df: df if scope is None else df.join(scope.select("document_id"), "document_id", "left_semi")
        fields = [n for n in _OWN if n != "valid_from"]
        o, n = inside(self._active()).select("instance_id", F.struct(*_OWN, "generation").alias("o")), desired.select("instance_id", F.struct(*fields).alias("n"))
        both = o.join(n, "instance_id", "full_outer").where(~F.col("o.record_digest").eqNullSafe(F.col("n.record_digest")))
        held = ["chunk_hash", "text", "vector", "model_id"]
        other = F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.struct(*[F.col(f"o.{c}") for c in held]).eqNullSafe(F.struct(*[F.col(f"n.{c}") for c in held]))
        both = written(both.select(F.when(other, F.raise_error(F.lit("an instance id has another content than before"))).otherwise(F.col("instance_id")).alias("instance_id"), "o", "n"), "delta")
        back = both.where("o IS NULL").select("instance_id").join(self._read("gone").where("valid_to IS NOT NULL"), "instance_id", "left_semi").limit(1).count()
        if back:
            raise BackendError("a tombstoned instance would become active again")
        tables = {
            "rows": both.where("n IS NOT NULL").select("n.*", F.coalesce("o.valid_from", now).alias("valid_from"), F.lit(generation).alias("generation")),
            "gone": both.where("o IS NOT NULL").select("instance_id", F.col("o.generation").alias("generation"), F.when(F.col("n").isNull(), now).alias("valid_to")),
            "documents": changes(inside(self.documents()), documents, _columns(DOCUMENTS), generation),
            "manifests": changes(inside(self.manifests()), manifests, mf.FIELDS, generation),
        }
        state = self._publish(tables, before, corpus_root=corpus_root, model_id=model_id, params_hash=params_hash, dimensions=dimensions)
        return self.merge() if len(state.folders) >= MERGE_AT else state

    def _rewrite(self, keep: Column) -> State:
        s = self.state()
        rows = self._current().where(keep)
        whole = lambda df: df.withColumns({"generation": F.lit(s.generation), "deleted": F.lit(False)})
        gone = rows.where("valid_to IS NOT NULL").select("instance_id", "generation", "valid_to")
        tables = {"rows": rows, "gone": gone, "documents": whole(self.documents()), "manifests": whole(self.manifests())}
        return self._publish(tables, s, True, corpus_root=s.corpus_root, model_id=s.model_id, params_hash=s.params_hash, dimensions=s.dimensions)

    def merge(self) -> State:
        """All folders into one, in a generation of its own; nothing else changes."""
        return self._rewrite(F.lit(True))

    def compact(self, before: datetime, dry_run: bool = False) -> int:
        """Deletes the tombstones at or before a time with a zone; how many there are."""
        if before.tzinfo is None:
            raise ValueError("the time needs a zone")
        n = eligible(self._current(), F.lit(before)).count()
        if n and not dry_run:
            self._rewrite(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(before)))
        return n

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the folders that none of the last ``keep`` commits lists, and older commit files; the folders' names.  Not beside a running writer."""
        if keep < 1:
            raise ValueError("keep must be positive")
        names = self._commits()
        used = {f for name in names[-keep:] for f in self._commit(name).folders}
        fs, p = self._fs(self.root)
        found = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("gen-")) if names else []
        gone = [f for f in found if f not in used]
        for path in [*(f"commits/{name}" for name in names[:-keep]), *gone]:
            fs, p = self._fs(f"{self.root}/{path}")
            fs.delete(p, True)
        return gone

    def query(self, vector: list[float], limit: int, model_id: str, params_hash: str) -> DataFrame:
        from ..operators.retrieval import top_k

        s = self.state()
        if s.generation == 0:
            raise BackendError("the index is empty")
        if (s.model_id, s.params_hash) != (model_id, params_hash) or len(vector) != s.dimensions:
            raise BackendError("the query was embedded by another model than the index")
        return top_k(self.active(), vector, limit).select("score", "chunk_hash", "text", "document_id", "start_offset", "end_offset", "metadata")


def _columns(schema: str) -> list[str]:
    return mf.FIELDS + [c.split()[0] for c in schema[len(mf.MANIFEST) :].split(", ") if c] if schema.startswith(mf.MANIFEST) else [c.split()[0] for c in schema.split(", ")]


def _problems(rows: DataFrame, tests: list[tuple[Column, str]], position: Column) -> DataFrame:
    """A test that is null counts as failed."""
    return rows.select("document_id", position.cast("int").alias("position"), F.explode(F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(p)) for t, p in tests]), lambda x: x.isNotNull())).alias("problem"))


def verify(chunks: DataFrame, documents: DataFrame, manifests: DataFrame, dimensions: int, model_id: str, params_hash: str, namespace: str = identity.NAMESPACE) -> DataFrame:
    """(document_id, position, problem): every inconsistency between the manifests, the documents' state and the active rows, and of the rows in themselves.

    Two full outer joins: manifests with documents by id, manifests' chunks with rows by (id, position).
    """
    no = F.lit(False)
    wanted = mf.documents(manifests).select("document_id", F.struct("root_hash", "chunk_count", "hard_cuts", "metadata").alias("m"))
    docs = documents.select("document_id", F.struct("root_hash", "chunk_count", "hard_cuts", "metadata").alias("d")).join(wanted, "document_id", "full_outer")
    both = F.col("m").isNotNull() & F.col("d").isNotNull()
    differ = lambda c: F.when(both, ~F.col(f"m.{c}").eqNullSafe(F.col(f"d.{c}"))).otherwise(no)
    same_json = lambda a, b: F.coalesce(F.to_json(F.try_parse_json(a)), F.lit("{}")) == F.coalesce(F.to_json(F.try_parse_json(b)), F.lit("{}"))
    by_doc = _problems(docs, [
        (F.col("d").isNull(), "document is missing"),
        (F.col("m").isNull(), "document is unexpected"),
        (differ("root_hash"), "root hash differs"),
        (differ("chunk_count"), "chunk count differs"),
        (differ("hard_cuts"), "hard-cut count differs"),
        (F.col("d.metadata").isNotNull() & F.try_parse_json("d.metadata").isNull(), "document metadata is not JSON"),
        (F.when(both, ~same_json(F.col("m.metadata"), F.col("d.metadata"))).otherwise(no), "document metadata differs"),
    ], F.lit(None))
    fields = [n for n in _NAMES if n not in ("document_id", "position")]
    active = chunks.where(F.col("valid_to").isNull()).withColumn("row_digest", record_digest(F.col, namespace))
    rows = active.groupBy("document_id", "position").agg(F.count("*").alias("n"), F.min_by(F.struct(*fields, "row_digest"), "instance_id").alias("r"))
    expected = mf.positions(manifests)
    wanted = expected.select("document_id", "position", F.struct(*[c for c in expected.columns if c not in ("document_id", "position")]).alias("m"))
    pair = rows.join(wanted, ["document_id", "position"], "full_outer")
    one, known = F.col("n") == 1, F.col("m").isNotNull() & F.col("r").isNotNull()
    text_hash = identity.framed_col(identity.domain("chunk", namespace), F.lit(identity.domain("chunk-identity", namespace)), F.coalesce("m.normalizer_version", F.lit(identity.domain("normalizer", namespace))), F.col("r.chunker_id"), F.col("r.chunker_params_hash"), F.col("r.text"))
    complete = (F.col("r.chunker_id") != "") & (F.col("r.chunker_params_hash") != "")
    row = lambda t: F.when(F.col("r").isNotNull() & one, t).otherwise(no)
    match = lambda t: F.when(known & one, t).otherwise(no)
    unlike = lambda c: match(~F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")))
    meta = F.try_parse_json("r.metadata")
    reserved = {"chunk_hash": "string", "start_offset": "int", "end_offset": "int", "token_count": "int"}
    by_row = _problems(pair, [
        (F.col("r").isNull(), "chunk is missing"),
        (F.col("m").isNull(), "chunk is unexpected"),
        (F.when(F.col("r").isNotNull(), F.col("n") > 1).otherwise(no), "more than one active row"),
        (unlike("chunk_hash"), "chunk hash differs"),
        (unlike("start_offset"), "start offset differs"),
        (unlike("end_offset"), "end offset differs"),
        (unlike("token_count"), "token count differs"),
        (match(~F.coalesce(F.col("r.boundary_kind") == "hard", no).eqNullSafe(F.col("m.hard_cut"))), "hard cut differs"),
        (match(~F.struct("m.chunker_id", "m.chunker_params_hash").eqNullSafe(F.struct("r.chunker_id", "r.chunker_params_hash"))), "chunker differs"),
        (row(~F.coalesce(complete, no)), "chunk identity is incomplete"),
        (row(F.coalesce(complete, no) & (text_hash != F.col("r.chunk_hash"))), "text doesn't match its chunk hash"),
        (row((F.col("r.model_id") != F.lit(model_id)) | (F.col("r.params_hash") != F.lit(params_hash))), "row has another model"),
        (row(~scoring.valid_vector(F.col("r.vector"))), "vector is invalid"),
        (row((F.size("r.vector") != dimensions) | (F.col("r.dimensions") != dimensions)), "vector has other dimensions"),
        (row(F.col("r.metadata").isNotNull() & meta.isNull()), "metadata is not JSON"),
        (match(~same_json(F.col("r.metadata"), F.col("m.metadata"))), "metadata differs"),
        *[(match(F.coalesce(F.try_variant_get(meta, f"$.{c}", kind) != F.col(f"m.{c}"), no)), f"metadata {c} differs") for c, kind in reserved.items()],
        (row((F.col("r.start_offset") < 0) | (F.col("r.end_offset") < F.col("r.start_offset")) | (F.col("r.token_count") < 0) | (F.col("position") < 0)), "offsets, position or token count out of range"),
        (row(F.col("r.row_digest") != F.col("r.record_digest")), "record digest differs"),
    ], F.col("position"))
    return by_doc.unionByName(by_row)

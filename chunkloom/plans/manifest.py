"""Manifests: what a corpus should look like in an index, document by document, as rows and as JSON.

A document's manifest has its chunk records in order, its metadata, the chunker's identity and the Merkle root over its chunk hashes.
A corpus's manifest is the set of them with the root over all; as a file it is JSON lines, a header first, so that it can be compared line by line.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackendError
from ..functions import identity
from ..operators import merkle

VERSION = 1
RECORD = "struct<chunk_hash:string,start_offset:int,end_offset:int,token_count:int,hard_cut:boolean,metadata:string>"
MANIFEST = f"document_id string, schema_version int, root_hash string, chunker_id string, chunker_params_hash string, normalizer_version string, metadata string, chunks array<{RECORD}>"
FIELDS = [c.split()[0] for c in MANIFEST.split(f", chunks array<{RECORD}>")[0].split(", ")] + ["chunks"]


def _root(chunks: Column, namespace: str) -> Column:
    return identity.merkle_root_col(F.transform(chunks, lambda c: c["chunk_hash"]), namespace)


def document_manifests(chunks: DataFrame, documents: DataFrame, namespace: str = identity.NAMESPACE) -> DataFrame:
    """Manifests of all documents (document_id, metadata), without chunks those that have none; chunks as chunk_documents makes them.

    It is an error if the chunks of a document come from two chunkers.
    """
    record = F.struct("position", F.struct("chunk_hash", "start_offset", "end_offset", "token_count", F.coalesce(F.col("boundary_kind") == "hard", F.lit(False)).alias("hard_cut"), "metadata").alias("r"))
    first, last = F.min(F.struct("chunker_id", "params_hash")), F.max(F.struct("chunker_id", "params_hash"))
    one = chunks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).cast(f"array<{RECORD}>").alias("chunks"), first.alias("first"), last.alias("last"))
    checked = F.when(F.col("first") == F.col("last"), F.col("chunks")).when(F.col("chunks").isNull(), F.array().cast(f"array<{RECORD}>")).otherwise(F.raise_error(F.lit("the chunks of a document come from two chunkers")).cast(f"array<{RECORD}>"))
    both = documents.select(F.col("document_id").cast("string"), F.col("metadata").alias("document_metadata")).join(one, "document_id", "left").withColumn("chunks", checked)
    return both.select(
        "document_id", F.lit(VERSION).alias("schema_version"), _root(F.col("chunks"), namespace).alias("root_hash"), F.coalesce(F.col("first.chunker_id"), F.lit("")).alias("chunker_id"), F.coalesce(F.col("first.params_hash"), F.lit("")).alias("chunker_params_hash"),
        F.when(F.col("first").isNull(), "").otherwise(identity.domain("normalizer", namespace)).alias("normalizer_version"), F.col("document_metadata").alias("metadata"), "chunks",
    )


def positions(manifests: DataFrame) -> DataFrame:
    """One row a chunk: the document's fields and (position, chunk_hash, start_offset, end_offset, token_count, hard_cut, metadata)."""
    own = manifests.select("document_id", "chunker_id", "chunker_params_hash", "normalizer_version", F.posexplode("chunks").alias("position", "c"))
    return own.select("document_id", "chunker_id", "chunker_params_hash", "normalizer_version", "position", "c.*")


def documents(manifests: DataFrame) -> DataFrame:
    """The documents' state that the manifests ask for."""
    return manifests.select("document_id", "root_hash", F.size("chunks").cast("long").alias("chunk_count"), F.size(F.filter("chunks", lambda c: c["hard_cut"])).cast("long").alias("hard_cuts"), "metadata")


def _json(value: Column) -> Column:
    """A scalar as JSON."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")


def _object(**fields: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def to_json(manifests: DataFrame) -> DataFrame:
    """(document_id, json): canonical, keys sorted and no blanks; metadata, canonical JSON already, as it is, an empty object for none."""
    meta = lambda c: F.coalesce(c, F.lit("{}"))
    record = lambda c: _object(**{k: _json(c[k]) for k in ("chunk_hash", "start_offset", "end_offset", "token_count", "hard_cut")}, metadata=meta(c["metadata"]))
    chunks = F.concat(F.lit("["), F.array_join(F.transform("chunks", record), ","), F.lit("]"))
    scalars = ("schema_version", "document_id", "root_hash", "chunker_id", "chunker_params_hash", "normalizer_version")
    return manifests.select("document_id", _object(**{k: _json(F.col(k)) for k in scalars}, metadata=meta(F.col("metadata")), chunks=chunks).alias("json"))


def from_json(rows: DataFrame, namespace: str = identity.NAMESPACE) -> DataFrame:
    """Manifests from a column json.  Fails on what isn't JSON, another schema version, an empty id, and a root that isn't that of the chunks; a missing root is made."""
    v = F.parse_json("json")
    get = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    raw = rows.select(v.alias("v"))
    listed = F.transform(F.coalesce(F.try_variant_get(F.col("v"), "$.chunks", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.struct(
        F.variant_get(c, "$.chunk_hash", "string").alias("chunk_hash"), F.variant_get(c, "$.start_offset", "int").alias("start_offset"), F.variant_get(c, "$.end_offset", "int").alias("end_offset"), F.variant_get(c, "$.token_count", "int").alias("token_count"),
        F.coalesce(F.try_variant_get(c, "$.hard_cut", "boolean"), F.lit(False)).alias("hard_cut"), _meta(F.to_json(F.try_variant_get(c, "$.metadata", "variant"))).alias("metadata"),
    ))
    text = lambda name: F.coalesce(get(f"$.{name}", "string"), F.lit("")).alias(name)
    out = raw.select(text("document_id"), F.coalesce(get("$.schema_version", "int"), F.lit(VERSION)).alias("schema_version"), get("$.root_hash", "string").alias("given"), text("chunker_id"), text("chunker_params_hash"), text("normalizer_version"), _meta(F.to_json(get("$.metadata", "variant"))).alias("metadata"), listed.alias("chunks"))
    root = _root(F.col("chunks"), namespace)
    fail = lambda why: F.raise_error(F.lit(why))
    checked = F.when(F.col("document_id") == "", fail("a manifest has no document id")).when(F.col("schema_version") != VERSION, fail("a manifest has an unknown schema version")).when(F.coalesce(F.col("given") != root, F.lit(False)), fail("a manifest's root isn't that of its chunks")).otherwise(root)
    return out.withColumn("root_hash", checked).select(*FIELDS)


def _meta(text: Column) -> Column:
    return F.when(text != "{}", text)


def with_documents(manifests: DataFrame, others: DataFrame) -> DataFrame:
    """manifests with those of others added, or put in the place of those of the same documents."""
    return manifests.join(others.select("document_id"), "document_id", "left_anti").select(*FIELDS).unionByName(others.select(*FIELDS))


def without_documents(manifests: DataFrame, ids: DataFrame) -> DataFrame:
    return manifests.join(ids.select("document_id"), "document_id", "left_anti").select(*FIELDS)


def write_mirror(manifests: DataFrame, path: str, namespace: str = identity.NAMESPACE, **header: Any) -> str:
    """The corpus's manifest as a folder of JSON lines, sorted by document, and a header with its root; the root.

    The folder is written under another name and put in place when it is whole.
    """
    spark = manifests.sparkSession
    root = merkle.corpus_root(documents(manifests), namespace).collect()[0].corpus_root
    part = f"{path}.{uuid.uuid4().hex}"
    to_json(manifests).orderBy("document_id").select(F.col("json").alias("value")).write.text(f"{part}/documents")
    spark.createDataFrame([(json.dumps({"schema_version": VERSION, "root_hash": root} | header, sort_keys=True),)], "value string").coalesce(1).write.text(f"{part}/header")
    jvm = spark._jvm
    target, made = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, part))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{part}.old")
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(made, target):
        raise BackendError("the index is committed, but its manifest's mirror could not be written: run index again")
    if had:
        fs.delete(old, True)
    return root


def read_mirror(spark: SparkSession, path: str, namespace: str = identity.NAMESPACE) -> tuple[dict[str, Any], DataFrame]:
    """The header and the manifests of a mirror; fails if a root, or an id that occurs twice, doesn't fit."""
    header = json.loads(spark.read.text(f"{path}/header").collect()[0].value)
    if header.get("schema_version") != VERSION:
        raise BackendError("the manifest has an unknown schema version")
    manifests = from_json(spark.read.text(f"{path}/documents").withColumnRenamed("value", "json"), namespace)
    if manifests.groupBy("document_id").count().where("count > 1").limit(1).count():
        raise BackendError("the manifest has a document twice")
    if merkle.corpus_root(documents(manifests), namespace).collect()[0].corpus_root != header.get("root_hash"):
        raise BackendError("the manifest's root isn't that of its documents")
    return header, manifests

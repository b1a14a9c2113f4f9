"""Text files as documents."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError

SUFFIXES = frozenset(
    ".c .cc .cfg .conf .cpp .css .csv .go .h .hpp .html .ini .java .js .json .jsx .md .mdx .php .py .rb .rs .rst .sh .sql .tex .toml .ts .tsx .txt .xml .yaml .yml".split()
)
DOCUMENTS = "document_id string, text string, metadata string"


def _excluded(relative: str, patterns: Iterable[str]) -> bool:
    """By the whole relative path, the file name, or from the right; a leading **/ may stand for no folder."""
    path = PurePosixPath(relative)
    return any(fnmatch.fnmatch(relative, v) or fnmatch.fnmatch(path.name, v) or path.match(v) for p in patterns for v in {p, p.removeprefix("**/")})


def discover(base: str, inputs: Sequence[str] = (), includes: Sequence[str] = ("**/*",), excludes: Sequence[str] = (), protected: Iterable[str] = ()) -> list[str]:
    """Paths relative to base, sorted.  Inputs, if any, replace the include globs and are the whole corpus; folders are searched."""
    root = Path(base).resolve()
    found: set[Path] = set()
    if inputs:
        for given in inputs:
            path = Path(given) if os.path.isabs(given) else root / given
            if not path.exists():
                raise SourceError(f"there is no {given}")
            found |= {p for p in path.rglob("*") if p.is_file()} if path.is_dir() else {path}
    else:
        found = {p for g in includes for p in root.glob(g) if p.is_file()}
    keep = {Path(p).resolve() for p in protected}
    out = set()
    for path in found:
        real = path.resolve()
        if not real.is_relative_to(root):
            raise SourceError(f"{path} is not below {root}")
        lexical = path if path.is_relative_to(root) else real
        relative = lexical.relative_to(root).as_posix()
        if real not in keep and not any(k in real.parents for k in keep) and path.suffix.casefold() in SUFFIXES and not _excluded(relative, excludes):
            out.add(relative)
    return sorted(out)


def load(spark: SparkSession, base: str, paths: Sequence[str]) -> DataFrame:
    """The files as documents: decoded as UTF-8 without a byte-order mark, read by the executors.

    A file with a zero byte among its first 8192 or with invalid UTF-8, or whose size is no longer that of the listing, fails the
    query; a repeated id fails here.  Names are taken as they are, brackets and stars included.
    """
    if len(set(paths)) != len(paths):
        raise SourceError("a document id occurs twice")
    if not paths:
        return spark.createDataFrame([], DOCUMENTS)
    root = Path(base).resolve()
    files = _opened(spark, root, paths)
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 8192)), "(..)", "$1 ")) > 0
    relative = _relative(root)
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("path"))).cast("binary")
    changed = F.octet_length("content") != F.col("length")
    text = F.decode(F.when(changed, fail("a file changed while it was read: ")).when(binary, fail("a binary file: ")).otherwise(F.col("content")), "UTF-8")
    plain = F.when(F.startswith(text, F.lit("﻿")), F.substring(text, 2, 1 << 30)).otherwise(text)
    metadata = F.to_json(F.struct((F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), relative.alias("path"), F.col("length").alias("size")))
    return files.select(relative.alias("document_id"), plain.alias("text"), metadata.alias("metadata"))


def _opened(spark: SparkSession, root: Path, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", str(root / p)) for p in paths])


def _relative(root: Path) -> Column:
    return F.substring(F.regexp_replace("path", "^file:/*", "/"), len(str(root)) + 2, 1 << 20)


def unchanged(docs: DataFrame, base: str, paths: Sequence[str]) -> DataFrame:
    """docs, loaded and written before, or an error if a file has another size or time by now than when it was listed."""
    if not paths:
        return docs
    root = Path(base).resolve()
    now = _opened(docs.sparkSession, root, paths).select(_relative(root).alias("document_id"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))
    was = docs.select("document_id", F.from_json("metadata", "mtime_ns long, size long").alias("m"))
    other = now.join(was, "document_id", "full_outer").where(~(F.col("m.mtime_ns").eqNullSafe(F.col("mtime_ns")) & F.col("m.size").eqNullSafe(F.col("size")))).limit(1).collect()
    if other:
        raise SourceError(f"a file changed while it was read: {other[0].document_id}")
    return docs


def unique_ids(docs: DataFrame) -> DataFrame:
    """docs, or an error if an id occurs twice."""
    twice = docs.groupBy("document_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise SourceError(f"the document id {twice[0][0]!r} occurs twice")
    return docs


__all__ = ["DOCUMENTS", "SUFFIXES", "discover", "load", "unchanged", "unique_ids"]

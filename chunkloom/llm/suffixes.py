"""Repeated passages by column-wise construction of a collection's suffix order (operator 9).

A passage of at least ``length`` words that occurs in two documents shows up as
two suffixes with a common prefix of that length.  Texts are first cut into
short overlapping pieces such that equal windows of ``length`` words always
fall into pieces of the same key, so each key's pieces are a collection of
their own, built apart from all others: one symbol of every piece is inserted in each
round, right to left, which updates the Burrows-Wheeler transform and the
longest common prefixes of the collection.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._dist import Scratch
from ._text import chain, column, mix, slices, spans, word_hashes

LENGTH = 50
SEED = 16
COLLECTION = 1_000_000
IN_MEMORY = 16_000_000


def runs(h: np.ndarray, first: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of all pieces; a window is the index of its first word.

    The key of a window is the least hash of its runs of ``seed`` words, which
    depends on the window's words only.  Consecutive windows of one text with
    the same key make a piece, of at most length - seed + 1 windows.
    """
    width = length - seed + 1
    k = chain(h, seed)
    if len(k) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, have = k, 1
    while have * 2 <= width:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    ok = np.ones(len(low), bool)
    for end in first[1:]:
        ok[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
    begin = np.flatnonzero(inside % width == 0)
    return key[begin].view(np.int64), at[begin], np.diff(begin, append=len(at))


class SequentialColumn:
    """An integer column that is only read from front to back and rewritten as a whole.

    Up to ``in_memory`` values it is a buffer; a longer one is a file in the
    folder that executors share, a new one for each round.
    """

    def __init__(self, folder: str | None, name: str, in_memory: int) -> None:
        self.folder, self.name, self.most, self.round, self.file, self.held = folder, name, in_memory, 0, None, io.BytesIO()

    def _system(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        return system, root

    def read(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(self.held.getbuffer(), np.int32)
        system, _ = self._system()
        with system.open_input_stream(self.file) as f:
            return np.frombuffer(f.read(), np.int32)

    def write(self, values: np.ndarray) -> None:
        old, self.round = self.file, self.round + 1
        if self.folder is None or len(values) <= self.most:
            self.held, self.file = io.BytesIO(values.astype(np.int32, copy=False).tobytes()), None
        else:
            system, root = self._system()
            self.file = f"{root}/{self.name}-{self.round}"
            with system.open_output_stream(self.file) as f:
                f.write(values.astype(np.int32, copy=False).tobytes())
        if old:
            self._system()[0].delete_file(old)

    def close(self) -> None:
        if self.file:
            self._system()[0].delete_file(self.file)


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo : hi]) for each pair lo < hi; long ranges go over minima of blocks."""
    out = np.empty(len(lo), values.dtype)
    block = 64
    long = hi - lo > 4 * block
    small = np.flatnonzero(~long)
    if len(small):
        out[small] = _reduce(values, lo[small], hi[small])
    big = np.flatnonzero(long)
    if len(big):
        least = np.minimum.reduceat(values, np.arange(0, len(values), block))
        a, b = -(-lo[big] // block), hi[big] // block
        got = _reduce(least, a, b)
        left, right = np.flatnonzero(a * block > lo[big]), np.flatnonzero(b * block < hi[big])
        got[left] = np.minimum(got[left], _reduce(values, lo[big][left], a[left] * block)) if len(left) else got[left]
        got[right] = np.minimum(got[right], _reduce(values, b[right] * block, hi[big][right])) if len(right) else got[right]
        out[big] = got
    return out


def _reduce(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    order = np.argsort(lo, kind="stable")
    pairs = np.empty(2 * len(lo), np.int64)
    pairs[::2], pairs[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values[-1:]), pairs)[::2]
    return out


def build(symbols: np.ndarray, first: np.ndarray, folder: str | None = None, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, suffix length, common prefix with the suffix before, preceding symbol) in the order of all suffixes.

    symbols: the texts' symbols (1, 2, ...) one after the other, first: n + 1
    offsets.  Each text ends with a marker below all symbols, markers in the order of
    texts.  A preceding symbol of 0 is the marker.  Round j inserts, for every
    text of at least j symbols, its suffix of length j: the suffix starts with
    symbol c and goes on with the suffix inserted a round ago, at row p, so its
    place is among those that start with c, after all whose rest is before p.  The
    common prefix with a neighbour is one longer than that of the rests, the
    least value between their rows.
    """
    n = len(first) - 1
    length = np.diff(first)
    bwt, lcp = SequentialColumn(folder, f"bwt-{uuid.uuid4().hex}", in_memory), SequentialColumn(folder, f"lcp-{uuid.uuid4().hex}", in_memory)
    before = lambda live, j: np.where(length[live] > j, symbols[np.minimum(first[1:][live] - j - 1, max(0, len(symbols) - 1))], 0) if len(symbols) else np.zeros(len(live), np.int64)
    text, size = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    head, rest = np.zeros(n, np.int32), np.arange(n, dtype=np.int64)
    bwt.write(before(np.arange(n), 0))
    lcp.write(np.zeros(n, np.int32))
    live, row = np.arange(n), np.arange(n, dtype=np.int64)
    for j in range(1, int(length.max(initial=0)) + 1):
        stay = length[live] >= j
        live, row = live[stay], row[stay]
        was_bwt, was_lcp = bwt.read(), lcp.read()
        c = was_bwt[row].astype(np.int64)
        key = c << 32 | row
        order = np.argsort(key)
        key, live, c, row = key[order], live[order], c[order], row[order]
        at = np.searchsorted(head.astype(np.int64) << 32 | rest, key)
        total = len(text) + len(live)
        new = at + np.arange(len(live))
        old = np.ones(total, bool)
        old[new] = False
        moved = np.flatnonzero(old)  # the new row of each old one

        def merge(a, b, new=new, old=old, total=total):
            out = np.empty(total, a.dtype)
            out[old] = a
            out[new] = b
            return out

        head, rest = merge(head, c), merge(rest, row)
        text, size = merge(text, live), merge(size, j)
        values = merge(was_lcp, 0)
        touched = np.unique(np.concatenate([new, new + 1]))
        touched = touched[(touched > 0) & (touched < total)]
        same = (head[touched] == head[touched - 1]) & (head[touched] > 0)
        values[touched] = 0
        touched = touched[same]
        values[touched] = 1 + range_min(was_lcp, rest[touched - 1] + 1, rest[touched] + 1)
        rest = np.where(head > 0, moved[rest], rest)
        bwt.write(merge(was_bwt, before(live, j)))
        lcp.write(values)
        row = new
    out = text, size, lcp.read().copy(), bwt.read().copy()
    bwt.close()
    lcp.close()
    return out


def flagged(words: list[np.ndarray], low: np.ndarray, high: np.ndarray, length: int, folder: str | None, in_memory: int) -> list[np.ndarray]:
    """For each piece, the offsets of its windows that occur in two documents; low and high: the least and greatest document of each piece."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    _, symbols = np.unique(np.concatenate(words), return_inverse=True)
    text, size, lcp, _ = build(symbols.astype(np.int64) + 1, first, folder, in_memory)
    group = np.cumsum(lcp < length) - 1
    at = np.flatnonzero(lcp < length)
    least, most = np.minimum.reduceat(low[text], at), np.maximum.reduceat(high[text], at)
    hit = (least < most)[group] & (size >= length)
    piece, offset = text[hit], np.diff(first)[text[hit]] - size[hit]
    order = np.lexsort((offset, piece))
    return np.split(offset[order], np.searchsorted(piece[order], np.arange(1, len(words))))


def repeated_passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED, collection: int = COLLECTION, in_memory: int = IN_MEMORY) -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words): the maximal stretches of a document covered by passages of at least ``length`` words that occur in another document too.

    Words are runs of anything but ASCII white space and compared by 64-bit hashes, whole pieces by hashes of those.
    Passages that one document repeats but no other has are not reported; rows
    of the same doc_id are one document, and their stretches are united.  Every
    copy is reported, the first one as well.  Rows whose doc_id or text is null and texts
    of fewer than ``length`` words have no rows here.  Other columns are not read.

    doc_id must be an integer column.  Keys that occur in one document only are dropped before texts are moved;
    equal pieces of a key are merged, with their least and greatest doc_id, while they are
    shuffled, so a passage in a million documents is one piece.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def keys_of(batches):
        for b in batches:
            ids = column(b, "doc_id").to_numpy()
            for lo, _, buf, offs in slices(column(b, "text")):
                starts, _, first = spans(buf, offs)
                key, at, _ = runs(word_hashes(buf, starts), first, length, seed)
                if len(key):
                    doc = np.searchsorted(first, at, "right") - 1
                    order = np.lexsort((key, doc))
                    new = np.ones(len(key), bool)
                    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    order = order[new]
                    yield pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(ids[lo + doc[order]])], ["key", "doc_id"])

    # keys of two documents: a hot key is aggregated before it is shuffled, and the join splits it over several tasks
    keyed = scratch.table(texts.mapInArrow(keys_of, "key long, doc_id long"), "keys")
    many = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    pairs = keyed.join(many.hint("merge"), "key", "left_semi")
    wanted = pairs.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).withColumnRenamed("doc_id", "_id")

    def cut(batches):
        for b in batches:
            ids, lists = column(b, "doc_id").to_numpy(), column(b, "keys")
            for lo, hi, buf, offs in slices(column(b, "text")):
                starts, ends, first = spans(buf, offs)
                h = word_hashes(buf, starts)
                key, at, number = runs(h, first, length, seed)
                doc = np.searchsorted(first, at, "right") - 1
                part = lists.slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                here = _member(doc, key, owner, part.flatten().to_numpy())
                if not here.any():
                    continue
                key, at, number, doc = key[here], at[here], number[here], doc[here]
                stop = at + number + length - 2
                prints = [_print(h[a : z + 1]) for a, z in zip(at, stop)]
                raw = [buf[starts[a] : ends[z]].tobytes().decode("utf-8", "surrogatepass") for a, z in zip(at, stop)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(prints, np.int64)), pa.array(ids[lo + doc]), pa.array((at - first[doc]).astype(np.int64)), pa.array(raw)], ["key", "print", "doc_id", "start", "words"])

    pieces = scratch.table(texts.join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "keys").mapInArrow(cut, "key long, print long, doc_id long, start long, words string"), "pieces")
    distinct = pieces.select("key", "print", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"), "words")
    found = _windows(scratch, distinct, 1, length, seed, collection, in_memory)
    covered = pieces.select("key", "print", "doc_id", "start").join(found, ["key", "print"]).select("doc_id", (F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") + length).alias("e"))
    ordered = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = covered.withColumn("reach", F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def _windows(scratch: Scratch, pieces: DataFrame, rank: int, length: int, seed: int, collection: int, in_memory: int) -> DataFrame:
    """Rows (key, print, lo, hi): runs of windows lo ... hi, of each different piece of pieces (key, print, low, high, words), that two documents hold.

    A key whose different pieces may have more than ``collection`` words, such as that of a phrase in the midst of ever other texts, is no collection
    for one task: its pieces are cut again by the next least hash (of this rank) of their windows, which depends on the window's words only as well, so equal windows
    still meet; and so on until every key fits.
    """
    width = length - seed + 1
    merged = pieces.groupBy("key", "print").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("words").alias("words"))

    def collections(df: DataFrame) -> DataFrame:
        return df.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_order(length, collection, scratch.path("columns"), in_memory), "key long, print long, lo long, hi long")

    number = pieces.select("key", "print").distinct().groupBy("key").count()
    hot = scratch.table(number.where(F.col("count") * (length + width - 1) > collection).select("key"), f"hot-{rank}")
    if rank >= width or not hot.limit(1).count():
        return collections(merged)

    def again(batches):
        for b in batches:
            words = column(b, "words")
            for lo, hi, buf, offs in slices(words):
                starts, ends, first = spans(buf, offs)
                h = word_hashes(buf, starts)
                rows = []
                for k in range(hi - lo):
                    mine = h[first[k] : first[k + 1]]
                    near = np.sort(np.lib.stride_tricks.sliding_window_view(chain(mine, seed), width), axis=1)[:, rank]
                    cuts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
                    for x, y in zip(cuts, np.append(cuts[1:], len(near))):
                        a, z = first[k] + x, first[k] + y + length - 2
                        rows.append((k, x, near[x], _print(h[a : z + 1]), buf[starts[a] : ends[z]].tobytes().decode("utf-8", "surrogatepass")))
                at = np.array([r[0] for r in rows]) + lo
                key = column(b, "key").to_numpy()[at]
                new = mix(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([r[2] for r in rows], np.uint64)).view(np.int64)
                took = [column(b, c).take(pa.array(at)) for c in ("key", "print", "low", "high")]
                yield pa.RecordBatch.from_arrays([*took, pa.array(np.array([r[1] for r in rows], np.int64)), pa.array(new), pa.array(np.array([r[3] for r in rows], np.int64)), pa.array([r[4] for r in rows])], ["key0", "print0", "low", "high", "off", "key", "print", "words"])

    cut = scratch.table(merged.join(hot, "key", "left_semi").mapInArrow(again, "key0 long, print0 long, low long, high long, off long, key long, print long, words string"), f"cut-{rank}")
    below = _windows(scratch, cut.select("key", "print", "low", "high", "words"), rank + 1, length, seed, collection, in_memory)
    up = below.join(cut.select("key", "print", "key0", "print0", "off"), ["key", "print"]).select(F.col("key0").alias("key"), F.col("print0").alias("print"), (F.col("lo") + F.col("off")).alias("lo"), (F.col("hi") + F.col("off")).alias("hi"))
    return collections(merged.join(hot, "key", "left_anti")).unionByName(up)


def _order(length: int, collection: int, folder: str, in_memory: int):
    """Whole keys, gathered into collections of about ``collection`` symbols."""

    def order(batches):
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            starts, _, first = _spans_of(column(b, "words"))
            key, pr, low, high = (column(b, k).to_numpy() for k in ("key", "print", "low", "high"))
            for k in range(b.num_rows):
                if size >= collection and key[k] != last:
                    yield _flag(held, length, folder, in_memory)
                    held, size = [], 0
                last = key[k]
                held.append((key[k], pr[k], low[k], high[k], starts[first[k] : first[k + 1]]))
                size += first[k + 1] - first[k]
        if held:
            yield _flag(held, length, folder, in_memory)

    return order


def _member(doc: np.ndarray, key: np.ndarray, have_doc: np.ndarray, have_key: np.ndarray) -> np.ndarray:
    """Whether each (doc, key) is among the given pairs."""
    both = np.concatenate([have_key, key])
    _, code = np.unique(both, return_inverse=True)
    code = np.concatenate([have_doc, doc]) * (int(code.max(initial=0)) + 1) + code
    return np.isin(code[len(have_key) :], code[: len(have_key)])


def _print(h: np.ndarray) -> int:
    return int(chain(h, len(h)).view(np.int64)[0])


def _spans_of(texts: pa.Array) -> tuple[np.ndarray, None, np.ndarray]:
    """Word hashes of all texts in place of starts, and the offsets of each text's words."""
    hashes, first = [], [np.zeros(1, np.int64)]
    base = 0
    for _, _, buf, offs in slices(texts):
        starts, _, f = spans(buf, offs)
        hashes.append(word_hashes(buf, starts))
        first.append(f[1:] + base)
        base += int(f[-1])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), None, np.concatenate(first)


def _flag(held: list[tuple], length: int, folder: str, in_memory: int) -> pa.RecordBatch:
    """Runs (key, print, lo, hi) of consecutive flagged windows lo ... hi of each piece."""
    offsets = flagged([x[4] for x in held], np.array([x[2] for x in held]), np.array([x[3] for x in held]), length, folder, in_memory)
    rows: list[list] = [[], [], [], []]
    for x, o in zip(held, offsets):
        if len(o):
            cut = np.flatnonzero(np.diff(o) > 1)
            lo, hi = o[np.concatenate([[0], cut + 1])], o[np.concatenate([cut, [len(o) - 1]])]
            rows[0] += [x[0]] * len(lo)
            rows[1] += [x[1]] * len(lo)
            rows[2] += lo.tolist()
            rows[3] += hi.tolist()
    return pa.RecordBatch.from_arrays([pa.array(np.array(r, np.int64)) for r in rows], ["key", "print", "lo", "hi"])


SQL = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS s, unnest(list_transform(range(0, len(w) - 49), lambda i: md5(array_to_string(w[i + 1 : i + 50], ' ')))) AS g FROM words WHERE len(w) >= 50
), shared AS (
  SELECT g FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)
), covered AS (
  SELECT DISTINCT doc_id, s, s + 50 AS e FROM windows JOIN shared USING (g)
), marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM covered
), islands AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM marked
)
SELECT doc_id, min(s)::BIGINT AS start_word, max(e)::BIGINT AS end_word, (max(e) - min(s))::BIGINT AS n_words FROM islands GROUP BY doc_id, island
"""

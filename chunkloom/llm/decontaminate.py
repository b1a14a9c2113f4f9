"""Benchmark decontamination by pigeonhole edit matching (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import column

ERROR_RATE = 0.1
SLICE_CHARS = 8_000_000


def normal(texts: pa.Array) -> pa.Array:
    """Lower case, runs of ASCII white space as one space, none at the ends."""
    return pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts))), " ")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length: with at most budget errors one is intact."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def budget_of(item: str, rate: float) -> int:
    return min(int(len(item) * rate), max(0, len(item) - 1))


def myers(pattern: str, text: str, limit: int) -> int | None:
    """Least edit distance of pattern to any substring of text, if at most limit (Myers 1999, one wide word)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best if best <= limit else None


def ancestors(cuts: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """For each piece (start, end) the (start, end, budget) of the joined pieces around it, up to the whole item.

    L joined pieces have a budget of L - 1 errors: if they match within it, so
    does one of any two parts they are split into, down to one exact piece.
    """
    paths: list[list[tuple[int, int, int]]] = [[] for _ in cuts]

    def split(lo: int, hi: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            split(lo, mid)
            split(mid, hi)
            for k in range(lo, hi):
                paths[k].append((cuts[lo][0], cuts[hi - 1][1], hi - lo - 1))

    split(0, len(cuts))
    return paths


def within_one(piece: str, text: str) -> bool:
    """Whether some beginning of text is piece with at most one error."""
    if text.startswith(piece):
        return True
    n, i = len(piece), 0
    for a, b in zip(piece, text):
        if a != b:
            break
        i += 1
    rest = piece[i + 1 :]
    return text[i + 1 : n] == rest or text[i : n - 1] == rest or text[i + 1 : n + 1] == piece[i:]


class Matcher:
    """All pieces of all items in one Aho-Corasick automaton; built once for each task."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(i, t, budget_of(t, rate)) for i, t in items if t]
        table: dict[str, list[tuple[int, int, list]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            parts = pieces(t, budget)
            for (at, piece), path in zip(parts, ancestors([(a, a + len(p)) for a, p in parts])):
                # the whole item comes last and is verified on merged windows
                steps = [(at - a, b - at, e, t[a:b]) for a, b, e in path[:-1]]
                side = pair = None
                if path and path[0][2] == 1:  # a pair of pieces: the other one lies right beside this one
                    a, b, _ = path[0]
                    side, pair = (t[at + len(piece) : b], None) if a == at else (None, t[a:at][::-1])
                    steps = steps[1:]
                table.setdefault(piece, []).append((k, at, side, pair, steps))
        self.machine = ahocorasick.Automaton()
        for piece, owners in table.items():
            self.machine.add_word(piece, (len(piece), owners))
        if table:
            self.machine.make_automaton()
        self.some = bool(table)

    def find(self, text: str):
        """(item_id, distance) of every item that occurs in text within its budget.

        From an exact piece the match is extended piece by piece, each step with
        the budget that joined pieces have, the first one right beside the piece, the others by Myers' algorithm; only hits that reach the whole item are verified on it.
        """
        if not self.some or not text:
            return
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.machine.iter(text):
            p = end + 1 - size
            for k, at, after_it, before_it, path in owners:
                if after_it is not None:
                    if not within_one(after_it, text[end + 1 : end + 2 + len(after_it)]):
                        continue
                elif before_it is not None and not within_one(before_it, text[max(0, p - len(before_it) - 1) : p][::-1]):
                    continue
                for before, after, e, part in path:
                    if myers(part, text[max(0, p - before - e) : p + after + e], e) is None:
                        break
                else:
                    _, t, budget = self.items[k]
                    windows.setdefault(k, []).append((max(0, p - at - budget), min(len(text), p - at + len(t) + budget)))
        for k, found in windows.items():
            item_id, t, budget = self.items[k]
            best = None
            found.sort()
            lo, hi = found[0]
            for a, b in [*found[1:], (1 << 62, 0)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                d = 0 if t in text[lo:hi] else myers(t, text[lo:hi], budget)
                if d is not None and (best is None or d < best):
                    best = d
                lo, hi = a, b
            if best is not None:
                yield item_id, best


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, distance): the document has a passage within edit distance rate x length of the item.

    Both sides are compared in lower case with white space collapsed; distance
    is the least over all passages.  An item with an error budget of e is cut
    into e + 1 pieces, one of which any such passage holds unchanged, so the
    exact hits of pieces lose nothing; the stretches of text around hits, merged
    where they overlap, are verified with Myers' bit-parallel algorithm.

    The items go to the executors in slices of at most slice_chars characters,
    and documents are scanned once for each slice, without a shuffle.  Null or
    blank items match nothing, null and empty texts hold nothing; a null doc_id
    is reported as null, a repeated row again, and a repeated item_id for each of its texts.
    Other columns are not read.  Empty tables give no rows.
    """
    given = _broadcasts(docs.sparkSession, benchmark, slice_chars)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("length(text) > 0")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for part in given:
        found = texts.mapInArrow(_scan(part, rate), f"doc_id {kind}, item_id long, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def _broadcasts(spark, benchmark: DataFrame, slice_chars: int) -> list:
    """The items in slices that are small enough to be sent to every executor."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct()
    number = max(1, -(-(items.agg(F.sum(F.length("text"))).collect()[0][0] or 0) // slice_chars))
    out = []
    for k in range(number):
        part = items if number == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(number)) == k)
        rows = part.collect()
        plain = normal(pa.array([r.text for r in rows], pa.string())).to_pylist()
        out.append(spark.sparkContext.broadcast(sorted({(r.item_id if r.item_id is not None else -1, t, r.item_id is None) for r, t in zip(rows, plain) if t})))
    return out


def _scan(given, rate: float):
    def scan(batches):
        matcher = Matcher([(None if null else i, t) for i, t, null in given.value], rate)
        for b in batches:
            ids, texts = column(b, "doc_id"), normal(column(b, "text"))
            row, item, distance = [], [], []
            for k in range(b.num_rows):
                for i, d in matcher.find(texts[k].as_py()):
                    row.append(k)
                    item.append(i)
                    distance.append(d)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(row, np.int64))), pa.array(item, pa.int64()), pa.array(distance, pa.int32())], ["doc_id", "item_id", "distance"])

    return scan


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of docs, all their columns, whose text holds no item in the sense of leaks: decided row by row, without a shuffle.

    Null and empty texts stay.
    """
    for part in _broadcasts(docs.sparkSession, benchmark, slice_chars):
        docs = docs.where(_holds_none(part, rate)(F.col("text").cast("string")))
    return docs


def _holds_none(given, rate: float):
    @F.arrow_udf(T.BooleanType())
    def holds_none(texts: pa.Array) -> pa.Array:
        matcher = _matcher(given, rate)
        return pa.array([next(matcher.find(t or ""), None) is None for t in normal(texts).to_pylist()], pa.bool_())

    return holds_none


_BUILT: dict[tuple[int, float], Matcher] = {}


def _matcher(given, rate: float) -> Matcher:
    """The automaton of a broadcast: the last one is kept by the Python worker."""
    key = (given.id if hasattr(given, "id") else id(given.value), rate)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher([(None if null else i, t) for i, t, null in given.value], rate)
    return _BUILT[key]

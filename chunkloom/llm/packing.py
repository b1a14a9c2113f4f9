"""Best-fit packing by linear grouping (operator 4).

The whole plan is made from the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are; documents then look up
their bin by their rank among the pieces of their length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._dist import Scratch, global_order
from ._text import column, slices, spans

CAPACITY = 2048
EPSILON = 0.1
GROUPS = 24


@dataclass
class Plan:
    """moves[l]: (first rank, count, first bin): of the pieces of length l, those of so many ranks go to so many consecutive bins."""

    capacity: int
    moves: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    bins: int = 0

    def put(self, length: int, rank: int, count: int, first_bin: int) -> None:
        self.moves.setdefault(length, []).append((rank, count, first_bin))


def linear_groups(histogram: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths, longest first, in groups of equal cardinality: (rounded-up length, [(length, count)])."""
    total = sum(histogram.values())
    size = -(-total // groups) if total else 1
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                out.append([])
                room = size
            k = min(left, room)
            out[-1].append((length, k))
            left, room = left - k, room - k
    return [(g[0][0], g) for g in out]


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Few-size cutting stock: (how many of each size, in how many bins), meeting the demand exactly.

    Column generation: the linear programme over the known configurations is
    solved by the simplex method on its square basis, a knapsack over the dual prices gives the
    next configuration, until none improves.  The rounded-down solution is kept and the rest, fewer bins than sizes, is
    filled greedily by knapsacks on what is still open.
    """
    n = len(sizes)
    d = np.array(demand, float)
    basis = [np.eye(n)[k] * (capacity // sizes[k]) for k in range(n)]
    x = np.array([d[k] / (capacity // sizes[k]) for k in range(n)])
    for _ in range(60 * n):
        matrix = np.array(basis).T
        price = np.linalg.solve(matrix.T, np.ones(n))
        value, column_ = knapsack(sizes, price, capacity, None)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(matrix, column_)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(0, x - theta * step)
        x[out] = theta
        basis[out] = column_
    left = np.array(demand, np.int64)
    made: dict[tuple[int, ...], int] = {}
    for c, times in sorted(zip((tuple(int(v) for v in b) for b in basis), x), key=lambda p: -p[1]):
        used = np.array(c)
        k = min(int(times + 1e-9), *(int(left[i] // used[i]) for i in np.flatnonzero(used)))
        if k > 0:
            made[c] = made.get(c, 0) + k
            left -= k * used
    while left.any():
        _, c = knapsack(sizes, np.array(sizes, float), capacity, left)
        used = c.astype(np.int64)
        k = min(int(left[i] // used[i]) for i in np.flatnonzero(used))
        made[tuple(int(v) for v in used)] = made.get(tuple(int(v) for v in used), 0) + k
        left -= k * used
    return [(list(c), k) for c, k in made.items()]


def knapsack(sizes: list[int], price: np.ndarray, capacity: int, most: np.ndarray | None) -> tuple[float, np.ndarray]:
    """The most valuable filling of one bin, with at most so many of each size (None: any number)."""
    best = np.zeros(capacity + 1)
    took = []
    for k, s in enumerate(sizes):
        limit = capacity // s if most is None else int(min(capacity // s, most[k]))
        number = np.zeros(capacity + 1, np.int32)
        if price[k] > 0 and limit:
            base, now = best, best.copy()
            for j in range(1, limit + 1):
                other = base[: capacity + 1 - j * s] + j * price[k]
                better = other > now[j * s :] + 1e-12
                now[j * s :][better] = other[better]
                number[j * s :][better] = j
            best = now
        took.append(number)
    at, out = int(best.argmax()), np.zeros(len(sizes))
    value = float(best[at])
    for k in range(len(sizes) - 1, -1, -1):
        out[k] = took[k][at]
        at -= int(out[k]) * sizes[k]
    return value, out


def plan(histogram: dict[int, int], capacity: int, epsilon: float = EPSILON, groups: int = GROUPS) -> Plan:
    """Bins for pieces of lengths 1 ... capacity, given how many there are of each.

    Large pieces, above epsilon x capacity, are rounded up within groups of
    equal cardinality, configurations of the few rounded sizes are optimised,
    and the actual lengths take the places of the rounded ones, which can only
    leave more room.  Small pieces then go, longest first, each into the
    fullest bin that takes it, else into a new bin.
    """
    out = Plan(capacity)
    large = {s: c for s, c in histogram.items() if s > epsilon * capacity and c}
    small = {s: c for s, c in histogram.items() if s <= epsilon * capacity and c}
    groups_ = linear_groups(large, groups)
    runs: list[list[int]] = []  # [room, first bin, number of bins]
    if groups_:
        # groups of the same rounded length share one row of the programme
        merged: dict[int, list[tuple[int, int]]] = {}
        for s, g in groups_:
            merged.setdefault(s, []).extend(g)
        sizes = sorted(merged, reverse=True)
        supply = [list(merged[s]) for s in sizes]
        rank = dict.fromkeys(large, 0)
        for use, times in configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], capacity):
            start = out.bins
            out.bins += times
            parts = [[capacity, start, times]]
            for k, number in enumerate(use):
                for _ in range(number):
                    parts = _substitute(out, parts, supply[k], rank)
            runs += parts
    rooms: dict[int, list[tuple[int, int]]] = {}
    for room, first, number in runs:
        rooms.setdefault(room, []).append((first, number))
    for s in sorted(small, reverse=True):
        left, at = small[s], 0
        fits = sorted(r for r in rooms if r >= s)
        while left:
            room = next((r for r in fits if rooms.get(r)), None)
            if room is None:
                need = -(-left // (capacity // s))
                rooms.setdefault(capacity, []).append((out.bins, need))
                out.bins += need
                room = capacity
            # best fit puts piece after piece into the same bin until it is full
            first, number = rooms[room].pop()
            each = room // s
            whole = min(number, left // each)
            if whole:
                for k in range(each):
                    out.put(s, at + k * whole, whole, first)
                at, left = at + each * whole, left - each * whole
                rooms.setdefault(room - each * s, []).append((first, whole))
                first, number = first + whole, number - whole
            if number and left and left < each:
                for k in range(left):
                    out.put(s, at + k, 1, first)
                rooms.setdefault(room - left * s, []).append((first, 1))
                at, left, first, number = at + left, 0, first + 1, number - 1
            if number:
                rooms.setdefault(room, []).append((first, number))
            for r in [r for r in rooms if not rooms[r]]:
                del rooms[r]
            fits = sorted(r for r in rooms if r >= s)
    return out


def _substitute(out: Plan, parts: list[list[int]], supply: list[tuple[int, int]], rank: dict[int, int]) -> list[list[int]]:
    """One actual piece, the next of the group, into every bin of parts."""
    done = []
    for room, first, number in parts:
        while number:
            length, left = supply[0]
            k = min(number, left)
            out.put(length, rank[length], k, first)
            rank[length] += k
            done.append([room - length, first, k])
            first, number = first + k, number - k
            supply[0] = (length, left - k)
            if left == k:
                supply.pop(0)
    return done


def packed(docs: DataFrame, capacity: int = CAPACITY, epsilon: float = EPSILON, groups: int = GROUPS) -> DataFrame:
    """Rows (bin, doc_id, start, length): words [start, start + length) of the document are in the bin.

    A length is a number of words.  A document longer than the capacity is cut
    into full pieces and a rest, so every word of every text is in exactly one
    bin, and no bin holds more than capacity words.  Null, empty and blank texts
    have no piece; a repeated row is packed again; a null doc_id is carried
    along, first among equal lengths; other columns are not read.  An empty table gives no rows.

    Shuffled are only (length, doc_id, start) of the pieces, sorted to rank them;
    the plan on the driver depends on the capacity, not on the number of documents.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            ids, texts = column(b, "doc_id"), column(b, "text")
            for lo, hi, buf, offs in slices(texts):
                words = np.diff(spans(buf, offs)[2])
                number = -(-words // capacity)
                row = np.repeat(np.arange(hi - lo), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * capacity
                length = np.minimum(capacity, words[row] - start)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(row)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32))], ["doc_id", "start", "length"])

    pieces = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, f"doc_id {kind}, start long, length int")
    ranked, _, _ = global_order(scratch, pieces, ["length"], "ranked", ["doc_id", "start", "length"])
    ranked = ranked.drop("name")
    histogram = {r[0]: (r[1], r[2]) for r in ranked.groupBy("length").agg(F.count("*"), F.min("row")).collect()}
    made = plan({s: c for s, (c, _) in histogram.items()}, capacity, epsilon, groups)
    tables = {}
    for s, moves in made.moves.items():
        moves = sorted(moves)
        tables[s] = (histogram[s][1] + np.array([m[0] for m in moves], np.int64), np.array([m[2] for m in moves], np.int64))
    given = docs.sparkSession.sparkContext.broadcast(tables)  # bounded by the capacity

    @F.arrow_udf(T.LongType())
    def bin_of(length: pa.Array, row: pa.Array) -> pa.Array:
        length, row = length.to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)
        out = np.empty(len(row), np.int64)
        for s in np.unique(length):
            here = length == s
            begin, first = given.value[int(s)]
            k = np.searchsorted(begin, row[here], "right") - 1
            out[here] = first[k] + row[here] - begin[k]
        return pa.array(out)

    return ranked.select(bin_of("length", "row").alias("bin"), "doc_id", "start", "length")


def held(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """Rows (doc_id, words, covered, bins_fit) of each document with a word, once packed: how many of its words are in bins, whether its pieces cover it without a gap or overlap, and whether none of its bins holds more than the capacity."""
    pieces = packed(docs, capacity, **how)
    load = pieces.groupBy("bin").agg(F.sum("length").alias("load"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "length")))
    ends = F.transform(F.col("p"), lambda x: x["start"] + x["length"])
    gapless = (F.element_at("p", 1)["start"] == 0) & (F.slice(ends, 1, F.size("p") - 1) == F.transform(F.slice("p", 2, F.size("p")), lambda x: x["start"]))
    by_doc = pieces.join(load, "bin").groupBy("doc_id").agg(F.sum("length").alias("words"), ordered.alias("p"), F.bool_and(F.col("load") <= capacity).alias("bins_fit"))
    return by_doc.select("doc_id", F.col("words").cast("long").alias("words"), gapless.alias("covered"), "bins_fit")


#: Of held.
SQL = r"""
WITH words AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n::BIGINT AS words, true AS covered, true AS bins_fit FROM words WHERE n > 0
"""

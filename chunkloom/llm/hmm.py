"""A hidden Markov language model over words (operator 5).

Every word of the corpus, told by its 64-bit hash, has an emission probability of its own: the
vocabulary is a set of tables in the shared folder that grow with the corpus.  Words
seen at least twice have a distribution over the states of their own as well; those
seen once share that of their class.
"""

from __future__ import annotations

import itertools
import logging
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import Scratch
from ._text import column, slices, spans, word_hashes

STATES = 8
SMOOTH = 0.01
SLICE_WORDS = 200_000
LONG, STRETCH = 1 << 14, 1 << 10  # texts of more words are cut into stretches of so many
PRIOR = 1.0  # counts added to each word's, spread over the states as its class is
CLASSES = 66
TOLERANCE = 0.01  # bits a word
BLOCK_WORDS, BLOCK_TEXTS, PART_WORDS, SIDES = 6_000_000, 200_000, 500_000, 64
START_TEXTS, START_CHARS, START_ROUNDS = 2_000, 600, 40

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

log = logging.getLogger(__name__)


@dataclass
class Model:
    """initial[s], step[s, t], emit[symbol, s]: probabilities."""

    initial: np.ndarray
    step: np.ndarray
    emit: np.ndarray


class Lattice:
    """The texts' symbols in time-major order: at each time those texts that are long enough, longest first.

    A text may be a stretch of a longer one: start and end then hold what comes before it (weights of the states at its
    first symbol) and after it (the backward variable at its last one, up to a factor), see stretches.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> None:
        length = np.diff(first)
        self.order = np.argsort(-length, kind="stable")
        self.order = self.order[: int((length > 0).sum())]
        length = length[self.order]
        longest = int(length[0]) if len(length) else 0
        self.active = len(length) - np.searchsorted(length[::-1], np.arange(1, longest + 1))
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        begin = first[:-1][self.order]
        doc = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        self.doc = doc
        self.symbols = symbols[begin[doc] + np.repeat(np.arange(longest), self.active)]
        self.start = None if start is None else start[self.order]
        self.end = None if end is None else end[self.order]
        self.last = self.at[length - 1] + np.arange(len(length)) if len(length) else np.zeros(0, np.int64)

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, scale factors and emissions, all time-major."""
        e = m.emit[self.symbols]
        alpha, scale = np.empty_like(e), np.empty(len(e))
        for t in range(len(self.active)):
            lo, hi = self.at[t], self.at[t + 1]
            now = alpha[lo:hi]
            if t:
                before = self.at[t - 1]
                np.matmul(alpha[before : before + hi - lo], m.step, out=now)
                now *= e[lo:hi]
            else:
                np.multiply(m.initial if self.start is None else self.start, e[lo:hi], out=now)
            c = now.sum(1)
            scale[lo:hi] = c
            now /= c[:, None]
        return alpha, scale, e

    def likelihoods(self, scale: np.ndarray, texts: int) -> np.ndarray:
        """log P of each text; 0 for one without a word."""
        out = np.zeros(texts)
        out[self.order] = np.bincount(self.doc, np.log(scale), minlength=len(self.order))
        return out

    def counts(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected initial, transition and, row by row, state counts; and the log-likelihood."""
        alpha, scale, e = self.forward(m)
        e /= scale[:, None]
        beta = np.ones_like(alpha)
        if self.end is not None:
            given = self.end / (alpha[self.last] * self.end).sum(1)[:, None]
            beta[self.last] = given
        step = np.ascontiguousarray(m.step.T)
        for t in range(len(self.active) - 2, -1, -1):
            lo, n = self.at[t], self.active[t + 1]
            nxt = self.at[t + 1]
            e[nxt : nxt + n] *= beta[nxt : nxt + n]
            np.matmul(e[nxt : nxt + n], step, out=beta[lo : lo + n])
        later = np.arange(self.at[1], len(alpha)) if len(self.active) > 1 else np.zeros(0, np.int64)
        earlier = np.repeat(self.at[:-2], self.active[1:]) + self.doc[later]
        trans = m.step * (alpha[earlier].T @ e[later])
        alpha *= beta
        return alpha[: self.at[1]].sum(0) if len(self.active) else np.zeros(len(m.initial)), trans, alpha, float(np.log(scale).sum())


def stretches(m: Model, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """A long text cut into stretches of STRETCH symbols: their begins, and for each the state weights at its first symbol given
    all before it and the backward variable at its last symbol given all after it; the expected first state; the expected steps
    between stretches; log P.

    Each stretch is a product of matrices, step x emissions symbol by symbol, so the products of all stretches are made side by side
    and only these products one after another: STRETCH steps in numpy and as many small ones as there are stretches, exact for any length.
    """
    n, states = len(symbols), len(m.initial)
    begin = np.arange(0, n, STRETCH)
    number = len(begin)
    whole = np.full((number, STRETCH), -1, np.int64)
    whole.reshape(-1)[:n] = symbols
    product, log = np.broadcast_to(np.eye(states), (number, states, states)).copy(), np.zeros(number)
    for t in range(STRETCH):
        live = number if whole[-1, t] >= 0 else number - 1  # only the last one is shorter
        e = m.emit[whole[:live, t]][:, None, :]
        now = (product[:live].reshape(-1, states) @ m.step).reshape(live, states, states) * e if t else product[:live] * e  # rows: the state at the first symbol
        c = now.sum((1, 2))
        product[:live] = now / c[:, None, None]
        log[:live] += np.log(c)
    start, end = np.empty((number, states)), np.ones((number, states))
    carry, total = m.initial, 0.0
    for k in range(number):
        start[k] = carry
        out = carry @ product[k]
        total += log[k] + np.log(out.sum())
        carry = out / out.sum() @ m.step
    for k in range(number - 2, -1, -1):
        back = m.step @ (product[k + 1] @ end[k + 1])
        end[k] = back / back.sum()
    between = np.zeros((states, states))
    for k in range(number - 1):
        before, after = start[k] @ product[k], product[k + 1] @ end[k + 1]
        joint = before[:, None] * m.step * after[None, :]
        between += joint / joint.sum()
    first = start[0] * (product[0] @ end[0])
    return begin, start, end, first / first.sum(), between, total


def _grouped(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None):
    """(rows, lattice) of groups of texts of similar length, of about SLICE_WORDS words each; begin, length: the texts in flat."""
    if not len(length):
        return
    order = np.argsort(length, kind="stable")
    group = np.cumsum(length[order]) // SLICE_WORDS
    for rows in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        n = length[rows]
        first = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(begin[rows] - first[:-1], n) + np.arange(first[-1])
        yield rows, Lattice(flat[take], first, None if start is None else start[rows], None if end is None else end[rows])


def likelihoods(m: Model, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log P of every text, exactly: by the scaled forward recursion, of texts longer than LONG by stretches."""
    out, long = np.zeros(len(length)), length > LONG
    for k in np.flatnonzero(long):
        out[k] = stretches(m, flat[begin[k] : begin[k] + length[k]])[-1]
    short = np.flatnonzero(~long)
    for rows, lattice in _grouped(flat, begin[short], length[short]):
        out[short[rows]] = lattice.likelihoods(lattice.forward(m)[1], len(rows))
    return out


def _expected(m: Model, ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of words, of first states and of steps, and the log-likelihood."""
    size, states = m.emit.shape
    emit, initial, step, total = np.zeros((size, states)), np.zeros(states), np.zeros((states, states)), 0.0

    def add(lattice: Lattice) -> tuple[np.ndarray, np.ndarray, float]:
        i, t, gamma, ll = lattice.counts(m)
        for s in range(states):
            emit[:, s] += np.bincount(lattice.symbols, gamma[:, s], minlength=size)
        return i, t, ll

    short = length <= LONG
    for _, lattice in _grouped(ids, begin[short], length[short]):
        i, t, ll = add(lattice)
        initial, step, total = initial + i, step + t, total + ll
    for k in np.flatnonzero(~short):
        text = ids[begin[k] : begin[k] + length[k]]
        at, start, end, first, between, ll = stretches(m, text)
        for _, lattice in _grouped(text, at, np.diff(at, append=len(text)), start, end):
            step = step + add(lattice)[1]
        initial, step, total = initial + first, step + between, total + ll
    return emit, initial, step, total


@dataclass
class Shape:
    """What is of a fixed size: initial[s], step[s, t], and how counts become emissions.

    emit[word, s] = (count[word, s] + PRIOR x share[class, s]) / norm[s].  A word's class is the binary
    logarithm of how often the corpus holds it, share the states' share of all counts of that class.  A word
    seen once counts as its class's share; class 0, of words never seen, has the share of the words seen once.
    Over all words and one never seen, the emissions of a state add up to 1.
    """

    initial: np.ndarray
    step: np.ndarray
    share: np.ndarray
    norm: np.ndarray

    def emissions(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        once = (n > 0.5) & (n < 1.5)
        return (np.where(once[:, None], self.share[1], counts) + PRIOR * self.share[classes(n)]) / self.norm


def classes(n: np.ndarray) -> np.ndarray:
    """0 for words never seen, else 1 + the binary logarithm, rounded down; n is whole but for rounding."""
    return np.where(n < 0.5, 0, 1 + np.floor(np.log2(np.maximum(n, 1) * 1.0001))).astype(np.int64)


def class_sums(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each class the sum of its words' counts by state, and last how many words it has."""
    k = classes(n)
    out = np.stack([np.bincount(k, c, minlength=CLASSES) for c in [*counts.T, np.ones(len(k))]], 1)
    out[0] = 0
    return out


def shape(initial: np.ndarray, step: np.ndarray, sums: np.ndarray, smooth: float = SMOOTH) -> Shape:
    """The model of expected counts; sums: see class_sums."""
    norm = lambda x: x / x.sum(-1, keepdims=True)
    by_state, size = sums[:, :-1].copy(), sums[:, -1].copy()
    share = norm(by_state + smooth)
    by_state[1] = size[1] * share[1]
    share[0], size[0] = share[1], 1  # one place for what was never seen
    return Shape(norm(initial + smooth), norm(step + smooth), share, by_state.sum(0) + PRIOR * (size[:, None] * share).sum(0))


def start(texts: pa.Array, states: int, seed: int = 3) -> tuple[Shape, np.ndarray, np.ndarray]:
    """A model with broken symmetry, from START_ROUNDS rounds over a bounded sample; the sample's words, sorted, and their counts.

    It is only where the rounds over all texts begin: a word that the sample doesn't hold has the emissions of class 0.
    """
    parts = [(word_hashes(buf, starts), np.diff(first)) for _, _, buf, offs in slices(texts) for starts, _, first in [spans(buf, offs)]]
    flat, length = (np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in ((0, np.uint64), (1, np.int64)))
    words, ids = np.unique(flat, return_inverse=True)
    rng = np.random.default_rng(seed)
    n = np.bincount(ids, minlength=len(words))
    counts = n[:, None] * rng.dirichlet(np.full(states, 0.5), len(words))
    now = shape(np.ones(states), np.eye(states) + 1 / states, class_sums(counts, n))
    for _ in range(START_ROUNDS if len(flat) else 0):
        counts, initial, step, _ = _expected(Model(now.initial, now.step, now.emissions(counts, n)), ids.astype(np.int32), np.cumsum(length) - length, length)
        now = shape(initial, step, class_sums(counts, n))
    return now, words, counts


def _files(root: str, name: str):
    fs, path = pafs.FileSystem.from_uri(root)
    return fs, f"{path}/{name}"


def _put(root: str, name: str, values: np.ndarray) -> None:
    fs, path = _files(root, name)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"  # a repeated task's file replaces the whole file
    with fs.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(values).tobytes())
    fs.move(part, path)


def _get(root: str, name: str, kind) -> np.ndarray:
    fs, path = _files(root, name)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return np.zeros(0, kind)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


def _runs(batches, key: str):
    """(key, rows) of a stream that is sorted by key."""
    rows = (r for b in batches for r in b.to_pylist())
    return itertools.groupby(rows, lambda r: r[key])


_PLACE = np.dtype([("place", np.int32), ("n", np.float32)])


class Corpus:
    """The texts as blocks of BLOCK_WORDS words in the shared folder, each with its own vocabulary, most frequent words first, and its words as places in it.

    Beside each block lie its words' distributions over the states, as half-precision numbers, for words seen at least twice; a word's
    number of occurrences never changes and is kept once.  Words of a single block never leave it; those
    of the other words meet by ranges of word hashes in one shuffle and return to the blocks, summed, in a second one.
    """

    def __init__(self, docs: DataFrame, learn: str) -> None:
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "hmm")
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn"))
        self.blocks = self.scratch.table(rows.mapInArrow(_blocks, f"block long, doc_id array<{self.id_type}>, length binary, learn binary, low binary, high binary, words binary, seen binary, texts long"), "blocks")
        n = self.blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("size"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()
        self.n_blocks, self.parts = max(1, n.blocks), 1 + n.size // 8 // PART_WORDS
        share = int((1 << 30) * min(1.0, START_TEXTS / max(1, n.texts)))
        drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share  # about START_TEXTS different texts, however many rows there are
        self.sample = rows.where("learn AND length(text) > 0").where(drawn).select(F.xxhash64("text").alias("h"), F.substring("text", 1, START_CHARS).alias("text")).distinct()
        self._exchange(self._occurrences(), _shared, "places", _PLACE)

    def _occurrences(self):
        parts = self.parts

        def occurrences(batches):
            for r in _rows(batches):
                order = np.argsort(r.words)
                vals = np.empty(len(order), _PLACE)
                vals["place"], vals["n"] = order, r.seen[order]
                yield _cut(parts, r.block, r.words[order], vals)

        return occurrences

    def _exchange(self, out, add, to: str, kind) -> list[np.ndarray]:
        """Runs out over the blocks, add over what it gives for each range of words; writes each block's part to a file of the folder ``to``."""
        root = self.scratch.root

        def put(batches):
            for block, rows in _runs(batches, "block"):
                if block < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(r["vals"]) for r in rows).tobytes()], pa.binary())], ["vals"])
                    continue
                _put(root, f"{to}/{block}", np.concatenate([np.frombuffer(r["vals"], kind) for r in rows]))  # ranges in the order of hashes

        kept = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # a round's shuffles go when it ends, not when the driver collects its garbage
        try:
            chunks = self.blocks.mapInArrow(out, "part int, block long, words binary, vals binary")
            summed = chunks.repartition(self.parts, "part").sortWithinPartitions("part").mapInArrow(add, "block long, part int, vals binary")
            got = summed.repartition(self.n_blocks, "block").sortWithinPartitions("block", "part").mapInArrow(put, "vals binary").collect()
        finally:
            self.spark.conf.set(CLEANUP, kept)
        return [np.frombuffer(bytes(r.vals)) for r in got]

    def round(self, given, r: int, states: int) -> tuple[Shape, float, float]:
        """One round of Baum-Welch from the model of round r: the next one, the log-likelihood of round r's and the number of words."""
        root, parts = self.scratch.root, self.parts

        def expect(batches):
            for b in _rows(batches):
                emit = b.emissions(root, given.value, r)
                length, learn = b.length, b.learn
                begin = np.cumsum(length) - length
                counts, initial, step, ll = _expected(Model(given.value[0].initial, given.value[0].step, emit), b.ids, begin[learn], length[learn])
                own = np.flatnonzero(b.local)
                half = _halves(counts[b.kept], b.n[b.kept])
                _put(root, f"local-{r + 1}/{b.block}", half)
                counts[b.kept] = half * b.n[b.kept][:, None]  # what the next round will see
                extra = np.concatenate([initial, step.ravel(), class_sums(counts[own], b.n[own]).ravel(), [ll, length[learn].sum()]])
                yield _cut(parts, b.block, b.words[b.busy], counts[b.busy].astype(np.float32))
                side = -1 - b.block % SIDES
                yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([side]), *[pa.array([x], pa.binary()) for x in (b"", extra.tobytes())]], ["part", "block", "words", "vals"])

        def add(batches):
            for part, rows in _runs(batches, "part"):
                rows = list(rows)
                if part < 0:
                    yield _sent(part, [(r["block"], r["vals"]) for r in rows])
                    continue
                each = [np.frombuffer(r["words"], np.uint64) for r in rows]
                _, inverse = np.unique(np.concatenate(each), return_inverse=True)
                vals = np.concatenate([np.frombuffer(r["vals"], np.float32) for r in rows]).reshape(-1, states)
                total = np.stack([np.bincount(inverse, v) for v in vals.T], 1)
                n = np.round(total.sum(1))
                half = _halves(total, n)
                ends = np.cumsum([len(w) for w in each])
                extra = np.concatenate([np.zeros(states + states * states), class_sums(half * n[:, None], n).ravel(), np.zeros(2)])
                yield _sent(part, [(r["block"], half[i].tobytes()) for r, i in zip(rows, np.split(inverse, ends[:-1]))] + [(-1 - part % SIDES, extra.tobytes())])

        got = self._exchange(expect, add, f"shared-{r + 1}", np.float16)
        self.scratch.drop(f"local-{r}", f"shared-{r}")
        x = sum(got) if got else np.zeros(states + states * states + CLASSES * (states + 1) + 2)
        a, b = states, states + states * states
        return shape(x[:a], x[a:b].reshape(states, states), x[b:-2].reshape(CLASSES, states + 1)), x[-2], x[-1]

    def scores(self, given, r: int) -> DataFrame:
        root = self.scratch.root

        def score(batches):
            for b in _rows(batches):
                model, n = Model(given.value[0].initial, given.value[0].step, b.emissions(root, given.value, r)), b.length
                ll = likelihoods(model, b.ids, np.cumsum(n) - n, n)
                bits = pa.array(-ll / np.log(2) / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([b.doc_id, pa.array(n), pa.array(ll), bits], ["doc_id", "n_words", "log_likelihood", "bits_per_word"])

        return self.blocks.mapInArrow(score, f"doc_id {self.id_type}, n_words long, log_likelihood double, bits_per_word double")


def _halves(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts as shares of the words' numbers of occurrences, in half precision."""
    return (counts / np.maximum(n, 1)[:, None]).astype(np.float16)


@dataclass
class _Block:
    block: int
    doc_id: pa.Array
    length: np.ndarray
    learn: np.ndarray
    ids: np.ndarray
    words: np.ndarray
    seen: np.ndarray

    def emissions(self, root: str, given, r: int) -> np.ndarray:
        """Emissions of the block's words in round r.

        Sets n, how often the corpus holds each word; busy, the places, by hash, of words of several blocks that are seen
        at least twice; local, all other words; and kept, the places of those of them seen at least twice.
        """
        model, words, counts = given
        shared = _get(root, f"places/{self.block}", _PLACE)
        self.n = self.seen.astype(np.float64)
        self.n[shared["place"]] = shared["n"]
        self.busy = shared["place"][shared["n"] > 1.5]
        self.local = np.ones(len(self.words), bool)
        self.local[self.busy] = False
        self.kept, states = np.flatnonzero(self.local & (self.n > 1.5)), len(model.initial)
        here, n = np.zeros((len(self.words), states)), self.n
        if r:
            for at, name in ((self.kept, "local"), (self.busy, "shared")):
                here[at] = _get(root, f"{name}-{r}/{self.block}", np.float16).reshape(-1, states) * self.n[at][:, None]
        elif len(words):
            at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
            here = np.where((words[at] == self.words)[:, None], counts[at], 0)
            n = here.sum(1)
        else:
            n = np.zeros(len(self.words))
        return model.emissions(here, n)


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            raw = lambda name: column(batch, name)[k].as_buffer()  # noqa: B023, E731
            length, words = np.frombuffer(raw("length"), np.int64), np.frombuffer(raw("words"), np.uint64)
            wide = lambda name, kind, n: np.frombuffer(pa.decompress(raw(name), n * np.dtype(kind).itemsize, "zstd"), kind)  # noqa: B023, E731
            total = int(length.sum())
            ids = wide("low", np.uint16, total).astype(np.int32) | wide("high", np.uint16, total).astype(np.int32) << 16
            yield _Block(column(batch, "block")[k].as_py(), column(batch, "doc_id")[k].values, length, np.frombuffer(raw("learn"), bool), ids, words, wide("seen", np.int64, len(words)))


def _blocks(batches):
    from pyspark import TaskContext

    pid, k, held, size, texts = TaskContext.get().partitionId(), 0, [], 0, 0

    def block():
        ids, length, learn, words = zip(*held)
        length, learn = np.concatenate(length).astype(np.int64), np.concatenate(learn)
        vocabulary, places, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        places = rank[places]
        seen = np.bincount(places[np.repeat(learn, length)], minlength=len(order)).astype(np.int64)
        ids = pa.concat_arrays(ids)
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        small = lambda x: pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(pid << 32) + k]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), blob(length), blob(learn), small((places & 0xFFFF).astype(np.uint16)), small((places >> 16).astype(np.uint16)),
                blob(vocabulary[order]), small(seen), pa.array([int((learn & (length > 0)).sum())], pa.int64()),
            ],
            ["block", "doc_id", "length", "learn", "low", "high", "words", "seen", "texts"],
        )

    for b in batches:
        ids, learn = column(b, "doc_id"), column(b, "learn").to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in slices(column(b, "text")):
            starts, _, first = spans(buf, offs)
            held.append((ids[lo:hi], np.diff(first), learn[lo:hi], word_hashes(buf, starts)))
            size, texts = size + len(starts), texts + hi - lo
            if size >= BLOCK_WORDS or texts >= BLOCK_TEXTS:
                yield block()
                k, held, size, texts = k + 1, [], 0, 0
    if held:
        yield block()


def _cut(parts: int, block: int, words: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    """Rows (part, block, words, vals): sorted words cut into ranges of the upper half of their hash."""
    of = ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
    cuts = list(zip(edge, edge[1:]))
    blob = lambda x: pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(of[edge[:-1]].astype(np.int32)), pa.array(np.full(len(cuts), block)), blob(words), blob(vals)], ["part", "block", "words", "vals"])


def _sent(part: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "part", "vals"])


def _shared(batches):
    """To each block the places of its words that another block holds too, and how often the corpus holds them."""
    for part, rows in _runs(batches, "part"):
        rows = list(rows)
        each = [np.frombuffer(r["words"], np.uint64) for r in rows]
        vals = np.concatenate([np.frombuffer(r["vals"], _PLACE) for r in rows])
        _, inverse, blocks = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        vals["n"] = np.bincount(inverse, vals["n"].astype(np.float64))[inverse]
        ends = np.cumsum([len(w) for w in each])[:-1]
        yield _sent(part, [(r["block"], v[m].tobytes()) for r, v, m in zip(rows, np.split(vals, ends), np.split(blocks[inverse] > 1, ends)) if m.any()])


def language_model_scores(docs: DataFrame, states: int = STATES, rounds: int | None = None, learn: str = "true") -> DataFrame:
    """Rows (doc_id, n_words, log_likelihood, bits_per_word), one for each row of docs.

    The model is trained on every word of the rows for which ``learn`` holds: rounds of Baum-Welch until one gains less than TOLERANCE
    bits a word, or as many as given.  The likelihood is exact, the scaled forward recursion over all words of the
    text; a text of more than LONG words is cut into stretches whose transfer matrices are multiplied, in training too, so
    memory is that of SLICE_WORDS words whatever its length.  The driver gets sums of a fixed size and the first START_CHARS characters of
    about START_TEXTS texts, from which only the start is made.

    A null or empty text has no words, log_likelihood 0 and null bits.  A null doc_id is carried along, a
    repeated row learnt from and scored again; other columns are not read.  An empty table gives no rows.
    """
    corpus = Corpus(docs, learn)
    spark = docs.sparkSession
    sample = sorted((r.h, r.text) for r in corpus.sample.collect())
    model, words, counts = start(pa.array([t for _, t in sample], pa.string()), states)
    none, r, before = np.zeros((0, states)), 0, -np.inf
    given = spark.sparkContext.broadcast((model, words, counts))
    while rounds is None or r < rounds:
        model, ll, n = corpus.round(given, r, states)
        given.unpersist()
        given, r = spark.sparkContext.broadcast((model, words[:0], none)), r + 1
        bits = ll / np.log(2) / max(n, 1)
        log.info("round %d: %.4f bits a word before it", r, -bits)
        if rounds is None and bits - before < TOLERANCE:
            break
        before = bits
    return corpus.scores(given, r)

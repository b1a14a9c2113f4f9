"""Document quality by a regularised quadratic discriminant (operator 1).

Three classes are modelled: clean, low quality, toxic.  Each document becomes
a vector of transformed statistics; each class has a mean and a covariance
shrunk towards the pooled one and its scaled identity.  The score of a document is its
log-density difference, clean against the likelier of the other two, with
Mahalanobis distances by the Cholesky factors that fitting has cached.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import column, slices, spans, word_hashes

MAX_LABELLED = 20_000
SHRINK = 0.1
RIDGE = 0.05
CLASSES = ("clean", "low", "toxic")
FEATURES = ("log_words", "word_chars", "upper", "digit", "symbol", "stop", "line_words", "distinct", "top_word", "marks", "lexicon")

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#$%&*@^~|<>{}[]\\_=+/"]] = 3
_KIND[[ord(c) for c in ".,;:!?"]] = 4
_KIND[10] = 5
_KIND[195] = 6  # the lead byte of most accented letters
MARKS = ".,;:!?#$%&*"
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True


@dataclass(frozen=True)
class Model:
    """means[k], cached lower Cholesky factors[k] and half log-determinants of the class covariances, log priors; the lexicon's words as sorted hashes."""

    means: np.ndarray
    factors: np.ndarray
    half_logdet: np.ndarray
    log_prior: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    lexicon: np.ndarray

    def densities(self, x: np.ndarray) -> np.ndarray:
        """log(prior x density) of each row for each class, without the common constant."""
        z = (x - self.centre) / self.scale
        out = np.empty((len(x), len(self.means)))
        for k, (mean, low) in enumerate(zip(self.means, self.factors)):
            y = np.linalg.solve(low, (z - mean).T)
            out[:, k] = self.log_prior[k] - self.half_logdet[k] - 0.5 * (y * y).sum(0)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = self.densities(x)
        return d[:, 0] - d[:, 1:].max(1) if len(x) else np.zeros(0)


def statistics(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts have zeros."""
    parts = [np.zeros((0, len(FEATURES)))]
    for _, _, buf, offs in slices(texts):
        starts, ends, first = spans(buf, offs)
        n, m = len(offs) - 1, len(starts)
        words = np.diff(first)
        doc = np.repeat(np.arange(n), words)
        chars = np.maximum(np.diff(offs), 1)
        kind = _KIND[buf]
        total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[offs])
        upper, digit, symbol, stop, lines, accent = (total(kind == k) for k in range(1, 7))
        fold = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
        h = word_hashes(fold, starts)
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.ones(m, bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, ds[at], np.diff(at, append=m))
        distinct = np.bincount(ds[at], minlength=n)
        tail = kind[np.maximum(ends - 1, 0)]
        hits = _bare_hits(fold, starts, ends, h, lexicon)
        w = np.maximum(words, 1)
        x = np.stack([
            np.log1p(words), np.log1p((chars - accent) / w), np.sqrt(upper / chars), np.sqrt(digit / chars), np.sqrt(symbol / chars),
            np.sqrt(stop / w), np.log1p(words / (lines + 1)), np.log1p(distinct) / np.maximum(np.log1p(words), 1e-9), np.sqrt(top / w),
            np.sqrt(np.bincount(doc, tail == 3, minlength=n) / w), np.log1p(np.bincount(doc, hits, minlength=n)),
        ], 1)
        x[words == 0] = 0
        parts.append(x)
    return np.concatenate(parts)


def _bare_hits(fold: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Whether each word, without marks at its end, is in the lexicon."""
    if not len(lexicon):
        return np.zeros(len(h), bool)
    hit = _isin(h, lexicon)
    marked = np.flatnonzero(_MARK[fold[ends - 1]] & ~hit) if len(ends) else np.zeros(0, np.int64)
    if len(marked):
        bare, left = fold.copy(), ends[marked] - 1
        while len(left):  # as many marks as the longest run of them
            left = left[_MARK[bare[left]]]
            bare[left] = 32
            left = left[left > 0] - 1
        kept = np.flatnonzero(~_space(bare[starts]))
        again = np.zeros(len(h), bool)
        again[kept] = _isin(word_hashes(bare, starts)[kept], lexicon)
        hit |= again
    return hit


def _space(b: np.ndarray) -> np.ndarray:
    return b == 32


def _isin(h: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    return lexicon[at] == h


def fit(x: np.ndarray, y: np.ndarray, lexicon: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """x: statistics, y: 0 clean, 1 low, 2 toxic.  A class without rows gets the pooled mean and no prior."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    d = z.shape[1]
    groups = [z[y == k] for k in range(len(CLASSES))]
    pooled = sum(((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups if len(g)), np.zeros((d, d))) / max(1, len(z))
    means, factors, half, prior = [], [], [], []
    for g in groups:
        mean = g.mean(0) if len(g) else np.zeros(d)
        own = np.cov(g.T, bias=True) if len(g) > 1 else pooled
        a = max(shrink, d / (d + len(g)))
        cov = (1 - a) * own + a * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(low)
        half.append(np.log(np.diag(low)).sum())
        prior.append(np.log(len(g) / len(z)) if len(g) else -1e9)
    return Model(np.array(means), np.array(factors), np.array(half), np.array(prior), centre, scale, lexicon)


def learn_lexicon(labelled: DataFrame, least: int = 4, share: float = 0.01, ratio: float = 20.0) -> np.ndarray:
    """Hashes of the words that mark toxic texts: they occur in at least ``least`` families of toxic texts, and in so
    many as make ``share`` of the toxic texts, ``ratio`` times as often there as in others, with one text more on the other side.

    A family is the texts with the same least hash of two adjacent words: near
    copies share it, so the rare words of a text that was copied often mark nothing.
    """
    counts = {y: n for y, n in labelled.groupBy(F.col("y") == 2).count().collect()}
    toxic, other = counts.get(True, 0), counts.get(False, 0)
    if not toxic:
        return np.zeros(0, np.uint64)
    split = F.split(F.lower("text"), "[ \\t\\n\\x0B\\f\\r]+")
    family = F.array_min(F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit("")))))
    words = F.array_distinct(F.transform("w", lambda w: F.rtrim(w, F.lit(MARKS))))
    # the family is made below the explode: above it, it would be made again for every word
    texts = labelled.select((F.col("y") == 2).alias("t"), split.alias("w")).select("t", F.when(F.col("t"), family).alias("family"), words.alias("words"))
    rows = texts.select("t", "family", F.explode("words").alias("word"))
    df = rows.where("length(word) > 0").groupBy("word", "family").agg(F.count_if("t").alias("t"), F.count("*").alias("n")).groupBy("word").agg(F.count("family").alias("families"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    rate = (F.col("t") / toxic) / ((F.col("n") - F.col("t") + 1) / max(1, other))
    chosen = [r.word for r in df.where((F.col("families") >= max(least, share * toxic)) & (rate >= ratio)).select("word").collect()]
    if not chosen:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer("\n".join(chosen).encode(), np.uint8)
    starts, _, _ = spans(buf, np.array([0, len(buf)]))
    return np.unique(word_hashes(buf, starts))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fits on at most about max_labelled labelled documents, drawn by a hash of their ids.

    Only the sample passes through the driver.  Labels that are null, or whose
    document is missing, null or empty, are not used, and equal texts count once.  Of
    several labels of a document, or of equal texts, the worst counts: toxic, then low, then clean.
    None if there is no clean or no other labelled document.
    """
    y = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & F.coalesce(F.col("toxic") == 0, F.lit(True)), 0)
    y = labels.select(F.col("doc_id").alias("_id"), y.alias("y")).where("y IS NOT NULL AND _id IS NOT NULL").groupBy("_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_labelled / max(1, labels.count()))
    drawn = y.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    # the sample's bound is also that of the broadcast: 12 bytes a row
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn) if max_labelled <= 1_000_000 else drawn, F.col("doc_id") == F.col("_id")).where("length(trim(text)) > 0").groupBy("text").agg(F.max("y").alias("y"))
    rows = rows.persist()  # lost blocks are computed again from docs
    try:
        lexicon = learn_lexicon(rows)

        def features(batches):
            for b in batches:
                x = statistics(column(b, "text"), lexicon)
                yield pa.RecordBatch.from_arrays([column(b, "y"), pa.FixedSizeListArray.from_arrays(x.ravel(), len(FEATURES)).cast(pa.list_(pa.float64()))], ["y", "x"])

        got = rows.mapInArrow(features, "y int, x array<double>").toArrow()
    finally:
        rows.unpersist()
    y_, x_ = got["y"].to_numpy(), np.array(got["x"].to_pylist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x_.T, y_))
    x_, y_ = x_[order], y_[order]
    if not (y_ == 0).any() or not (y_ > 0).any():
        return None
    return fit(x_, y_, lexicon)


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = 0.0) -> DataFrame:
    """Rows (doc_id, score, label, keep), one for each row of docs.

    score is the log-density difference of the class clean and the likelier of
    low and toxic; keep is score >= threshold and label the likeliest class.
    A null or empty text has a null score and label and is not kept.  A null
    doc_id is scored as any other row.  Without labels to learn from every
    score is null and every non-empty text is kept.  Other columns are not read.
    """
    model = train(docs, labels, max_labelled)
    return score_with(docs, model, threshold)


def score_with(docs: DataFrame, model: Model | None, threshold: float = 0.0) -> DataFrame:
    def score(batches):
        for b in batches:
            texts = column(b, "text")
            words = np.zeros(len(texts), bool)
            for lo, hi, buf, offs in slices(texts):
                words[lo:hi] = np.diff(spans(buf, offs)[2]) > 0
            if model is None:
                values, label = [None] * len(words), [None] * len(words)
                keep = words
            else:
                d = model.densities(statistics(texts, model.lexicon))
                s = d[:, 0] - d[:, 1:].max(1)
                values = pa.array(np.where(words, s, 0.0), mask=~words)
                label = [CLASSES[k] if w else None for k, w in zip(d.argmax(1), words)]
                keep = words & (s >= threshold)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(values, pa.float64()) if isinstance(values, list) else values, pa.array(label, pa.string()), pa.array(keep)], ["doc_id", "score", "label", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, f"doc_id {kind}, score double, label string, keep boolean")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.0) -> DataFrame:
    """The rows of docs, all their columns, that score_with would keep: decided row by row, without a join."""

    @F.arrow_udf(T.BooleanType())
    def keep(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for lo, hi, buf, offs in slices(texts):
            out[lo:hi] = np.diff(spans(buf, offs)[2]) > 0
        return pa.array(out & (model.scores(statistics(texts, model.lexicon)) >= threshold) if model is not None else out)

    return docs.where(keep(F.col("text").cast("string")))

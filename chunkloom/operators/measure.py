"""Edits, chunk churn between strategies, and benchmark grids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, text as tx
from ..functions.scoring import price
from ..shared import written
from . import fixtures, retrieval
from .chunking import Chunker, ContentDefined, Fixed, Recursive, Semantic, chunk_documents
from .diff import churn
from .embedding import HashProvider, Provider

SLICE_ROWS = 256  # texts and their edits that a task holds at once
PRICE = 0.02  # US dollars a million tokens: an illustration, no provider's current price

_STOP = re.compile(r"[.!?](?!\S)")
_BLANK = re.compile(r"\r?\n[ \t]*\r?\n")
_HEADING = re.compile(r"^#{1,6}[ \t]+[^\r\n]", re.M)
_TERM = re.compile(r"\b[A-Za-z][A-Za-z0-9_-]{3,}\b")
_NOISE = frozenset("after before each from into must only shall that their then this when with".split())
SENTENCE, PARAGRAPH, SECTION, ENDING = "An added remark stands here.", "An added paragraph stands here, of two clauses.", "## Added part\n\nIts only paragraph.", "## Closing part\n\nIts last paragraph.\n"


def _trimmed(t: str, cuts: list[int]) -> list[tuple[int, int]]:
    """The parts of t between cuts that aren't blank, from their first visible character on."""
    parts = ((a + len(t[a:b]) - len(t[a:b].lstrip()), b) for a, b in zip(cuts, cuts[1:]))
    return [(a, b) for a, b in parts if a < b]


def _sentences(t: str) -> list[tuple[int, int]]:
    """Each ends behind a full stop, exclamation or question mark before white space; what is left is a sentence, too."""
    return _trimmed(t, [0, *(m.end() for m in _STOP.finditer(t)), len(t.rstrip())])


def _paragraphs(t: str) -> list[tuple[int, int]]:
    gaps = [(0, 0), *(m.span() for m in _BLANK.finditer(t)), (len(t), len(t))]
    return [(a, b) for (_, a), (b, _) in zip(gaps, gaps[1:]) if t[a:b].strip()]


def _sections(t: str) -> list[tuple[int, int]]:
    """From heading to heading; paragraphs, where there aren't two headings.  A title block is none if body sections follow it."""
    at = [m.start() for m in _HEADING.finditer(t)]
    parts = list(zip(at, [*at[1:], len(t)])) if len(at) > 1 else _paragraphs(t)
    return parts[1:] if len(parts) > 2 and t.startswith("# ", parts[0][0]) and t.startswith("## ", parts[1][0]) else parts


def _need(parts: list, n: int) -> list:
    if len(parts) < n:
        raise ValueError("the text has too few parts for this edit")
    return parts


def _put(t: str, at: int, what: str, gap: str) -> str:
    return gap.join(x for x in (t[:at].rstrip(), what.strip(), t[at:].lstrip()) if x or x is what)


def insert_sentence(t: str) -> str:
    return _put(t, _need(_sentences(t), 1)[0][1], SENTENCE, " ")


def insert_paragraph(t: str) -> str:
    parts = _need(_paragraphs(t), 1)
    return _put(t, parts[:2][-1][1], PARAGRAPH, "\n\n")


def insert_section(t: str) -> str:
    return _put(t, _need(_sections(t), 1)[0][1], SECTION, "\n\n")


def _line_end(t: str, out: str) -> str:
    return out + "\n" * t.endswith("\n")


def delete_sentence(t: str) -> str:
    a, b = _need(_sentences(t), 2)[1]
    return _line_end(t, " ".join(x for x in (t[:a].rstrip(), t[b:].lstrip()) if x).rstrip())


def delete_paragraph(t: str) -> str:
    a, b = _need(_paragraphs(t), 2)[1]
    return _line_end(t, f"{t[:a].rstrip()}\n\n{t[b:].lstrip()}".strip())


def replace_letter(t: str) -> str:
    n = len(t)
    at = next((i for k in range(n) for i in [(min(n - 1, n // 3) + k) % n] if t[i].isascii() and t[i].isalpha()), None)
    if at is None:
        raise ValueError("the text has no letter to replace")
    return t[:at] + {"z": "a", "Z": "A"}.get(t[at], chr(ord(t[at]) + 1)) + t[at + 1 :]


def reorder_sections(t: str) -> str:
    (a, b), (c, d) = _need(_sections(t), 2)[:2]
    return "\n\n".join((t[:a] + t[c:d].rstrip(), t[a:b].rstrip(), t[d:].lstrip()))


def append_section(t: str) -> str:
    return t.rstrip() + "\n\n" + ENDING


def replaced_term(t: str) -> str:
    """The spelling, where it first stands, of the repeated word that is most frequent, of several the first in the alphabet."""
    found = [(w.casefold(), w) for w in _TERM.findall(t)]
    count = Counter(k for k, _ in found if k not in _NOISE)
    term = min((k for k, n in count.items() if n > 1), key=lambda k: (-count[k], k), default=None)
    if term is None:
        raise ValueError("the text repeats no word")
    return next(w for k, w in found if k == term)


def replace_everywhere(t: str, find: str | None = None, replacement: str | None = None) -> str:
    find = find or replaced_term(t)
    replacement = f"{find}-revised" if replacement is None else replacement
    if replacement == find:
        raise ValueError("the replacement is what it replaces")
    out, n = re.subn(rf"(?<!\w){re.escape(find)}(?!\w)", lambda _: replacement, t, flags=re.I)
    if not n:
        raise ValueError(f"the text doesn't hold {find!r}")
    return out


EDITS: dict[str, Callable[[str], str]] = {
    "insert-sentence": insert_sentence, "insert-paragraph": insert_paragraph, "insert-section": insert_section, "delete-sentence": delete_sentence, "delete-paragraph": delete_paragraph,
    "replace-same-length": replace_letter, "reorder-sections": reorder_sections, "append": append_section, "global-replace": replace_everywhere,
}


def apply_edit(text: str, operation: str, **how: str | None) -> str:
    """how: find and replacement of global-replace."""
    if not text:
        raise ValueError("an empty text cannot be edited")
    return EDITS[operation](text, **how)


def edited(docs: DataFrame, operations: tuple[str, ...] = tuple(EDITS)) -> DataFrame:
    """(document_id, operation, text) of every document and every edit that its text supports."""

    def run(batches):
        for b in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            out: list[list] = [[], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for op in operations:
                    try:
                        revised = apply_edit(text or "", op)
                    except ValueError:
                        continue
                    for k, v in enumerate((doc, op, revised)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["document_id", "operation", "text"])

    return docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "document_id string, operation string, text string")


def default_strategies() -> dict[str, Chunker]:
    """Small parameters for benchmarks on short texts."""
    cdc = ContentDefined(window_words=8, min_tokens=24, max_tokens=64, primary_mask_bits=5, backup_mask_bits=3)
    snap = ContentDefined(window_words=8, min_tokens=24, max_tokens=64, primary_mask_bits=5, backup_mask_bits=3, snap_window_words=8, snap_to_boundaries=True)
    return {"fixed": Fixed(size=48), "recursive": Recursive(max_tokens=64, min_tokens=16), "semantic-lexical-proxy": Semantic(max_tokens=64, min_tokens=16), "cdc-rabin": cdc, "cdc-rabin+snap": snap}


def corpora() -> list[tuple[str, str, str]]:
    """(corpus, document_id, text) of the fixtures."""
    return [(c.name, d, t) for c in fixtures.CORPORA for d, t in c.documents.items()]


def edit_cases(docs: DataFrame, operations: tuple[str, ...] = tuple(EDITS), most: int = 64) -> DataFrame:
    """(corpus, document_id, operation, original, revised): every operation on one document of each corpus, the longest that supports all
    of them, of equally long ones that of the least id.  docs: (corpus, document_id, text).

    Candidates are tried from the longest on, ``most`` at a time, and only in corpora that have none yet; it is an error if a corpus has none at all.
    """
    order = Window.partitionBy("corpus").orderBy(F.desc(F.length("text")), "document_id")
    sized = docs.select("corpus", "document_id", "text").withColumn("n", F.row_number().over(order))
    total = {r.corpus: r.n for r in sized.groupBy("corpus").agg(F.max("n").alias("n")).collect()}
    out, after, left = None, 0, set(total)
    while left:
        some = sized.where((F.col("n") > after) & (F.col("n") <= after + most) & F.col("corpus").isin(*left))
        made = edited(some.select(F.to_json(F.struct("corpus", "document_id", "n")).alias("document_id"), "text"), operations)
        key = F.from_json("document_id", "corpus string, document_id string, n int")
        made = made.withColumn("key", key).select("key.*", "operation", F.col("text").alias("revised"))
        whole = written(made.withColumn("of", F.count("*").over(Window.partitionBy("corpus", "n"))).where(F.col("of") == len(operations)).withColumn("first", F.min("n").over(Window.partitionBy("corpus"))).where("n = first"), "edits")
        found = whole.join(some.select("corpus", "n", F.col("text").alias("original")), ["corpus", "n"]).select("corpus", "document_id", "operation", "original", "revised")
        out = found if out is None else out.unionByName(found)
        left -= {r.corpus for r in whole.select("corpus").distinct().collect()}
        after += most
        lost = sorted(c for c in left if total[c] <= after)
        if lost:
            raise ValueError(f"no document of {lost[0]!r} supports every edit")
    if out is None:
        raise ValueError("there is no corpus")
    return out


def benchmark_churn(docs: DataFrame, strategies: Mapping[str, Chunker] | None = None, operations: tuple[str, ...] = tuple(EDITS), usd_per_million: float | None = PRICE) -> DataFrame:
    """(strategy, corpus, document_id, operation, ...churn, estimated_cost), a row for each strategy, corpus and operation.

    One document of each corpus is edited, see edit_cases; its unchanged siblings count as well, so reembed_fraction is the share of the whole
    revised corpus.  docs: (corpus, document_id, text).  Each text is chunked once by each strategy.
    """
    cases = written(edit_cases(docs, operations), "cases")
    chosen = cases.select("corpus", F.col("document_id").alias("edited")).distinct()
    # a text is known by its corpus, document and operation; those of no operation are the committed ones
    key = lambda op: F.to_json(F.struct("corpus", "document_id", op.alias("operation"))).alias("document_id")
    given = docs.select(key(F.lit("")), "text").unionByName(cases.select(key(F.col("operation")), F.col("revised").alias("text")))
    parsed = F.from_json("document_id", "corpus string, document_id string, operation string")
    out = None
    for name, chunker in (strategies or default_strategies()).items():
        chunks = written(chunk_documents(given, chunker).select(parsed.alias("key"), "chunk_hash", "token_count").select("key.*", "chunk_hash", "token_count"), "chunks")
        base, ops = chunks.where("operation = ''").drop("operation"), cases.sparkSession.createDataFrame([(o,) for o in operations], "operation string")
        old = base.join(F.broadcast(ops))  # nine operations
        siblings = base.join(F.broadcast(chosen), "corpus").where("document_id <> edited").drop("edited").join(F.broadcast(ops))
        new = siblings.unionByName(chunks.where("operation <> ''").select(*siblings.columns))
        part = churn(old, new, ["corpus", "operation"]).join(F.broadcast(chosen.withColumnRenamed("edited", "document_id")), "corpus")
        part = part.select(F.lit(name).alias("strategy"), "corpus", "document_id", "operation", *[c for c in part.columns if c not in ("corpus", "document_id", "operation")], price(F.col("tokens_to_embed"), usd_per_million).alias("estimated_cost"))
        out = part if out is None else out.unionByName(part)
    return out


def totals(results: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Sums over rows of benchmark_churn; the fraction is the chunks to embed over the revised ones, so weighted by size."""
    sums = [F.sum(c).alias(c) for c in ("original_chunks", "revised_chunks", "reused_chunks", "added_chunks", "removed_chunks", "tokens_to_embed")]
    weighted = F.when(F.sum("revised_chunks") == 0, 0.0).otherwise(F.sum("added_chunks") / F.sum("revised_chunks"))
    return results.groupBy(*by).agg(F.count("*").alias("cases"), *sums, weighted.alias("reembed_fraction"), F.sum("estimated_cost").alias("estimated_cost"))


def snapshot(chunks: DataFrame, namespace: str = identity.NAMESPACE) -> DataFrame:
    """Chunks of any splitter as (chunk_hash, text, token_count): the text is in a column text or page_content; a hash that is missing is made
    from the text, a token count that is missing is its number of words."""
    names = set(chunks.columns)
    body = [c for c in ("page_content", "text") if c in names]
    if not body:
        raise TypeError("chunks need a column text or page_content")
    text = F.coalesce(*map(F.col, body))
    made = identity.framed_col(identity.domain("measure-chunk", namespace), text)
    given = F.when(F.col("chunk_hash") != "", F.col("chunk_hash")) if "chunk_hash" in names else F.lit(None).cast("string")
    count = F.when(F.col("token_count") >= 0, F.col("token_count")) if "token_count" in names else F.lit(None).cast("int")
    return chunks.select(F.coalesce(given, made).alias("chunk_hash"), text.alias("text"), F.coalesce(count, F.size(tx.words(text))).cast("int").alias("token_count"))


SCORERS = ("lexical", "hash-embedding")


def benchmark_retrieval(docs: DataFrame, questions: DataFrame, strategies: Mapping[str, Chunker] | None = None, scorers: tuple[str, ...] = SCORERS, k: int = 5, provider: Provider | None = None) -> DataFrame:
    """(strategy, scorer, corpus, question_id, relevant, recall, ndcg): each question against the chunks of its corpus.

    docs: (corpus, document_id, text), questions: (corpus, question_id, query, evidence array); a chunk is relevant if it holds a passage of the evidence.
    Equal scores rank by document and position.  It is an error if a question's corpus is unknown, or no chunk of a strategy holds its evidence.
    """
    if k < 1:
        raise ValueError("k must be positive")
    unknown = questions.join(docs.select("corpus").distinct(), "corpus", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"question {unknown[0].question_id!r} is about an unknown corpus")
    if not questions.limit(1).count():
        raise ValueError("there is no question")
    parsed = F.from_json("document_id", "corpus string, document_id string")
    keyed = docs.select(F.to_json(F.struct("corpus", "document_id")).alias("document_id"), "text")
    out = None
    for name, chunker in (strategies or default_strategies()).items():
        chunks = chunk_documents(keyed, chunker).select(parsed.alias("key"), "position", "text").select("key.corpus", F.struct("key.document_id", "position").alias("chunk_id"), "text")
        chunks = written(chunks, "chunks")
        relevant = retrieval.holding(chunks, questions)
        missing = questions.join(relevant.select("corpus", "question_id").distinct(), ["corpus", "question_id"], "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"no chunk of {name!r} holds the evidence of question {missing[0].question_id!r}")
        for scorer in scorers:
            if scorer == "lexical":
                scored = retrieval.tfidf_scores(chunks, questions, by=["corpus"])
            elif scorer == "hash-embedding":
                scored = retrieval.embedding_scores(chunks, questions, provider or HashProvider(), by=["corpus"])
            else:
                raise ValueError(f"unknown scorer {scorer!r}; there are {', '.join(SCORERS)}")
            every = retrieval.with_unscored(scored, chunks, questions, max(k, 10))
            quality = retrieval.retrieval_quality(retrieval.ranked(every, by=["corpus"]), relevant, k_recall=k, by=["corpus"])
            count = relevant.groupBy("corpus", "question_id").agg(F.count("*").alias("relevant"))
            part = quality.join(count, ["corpus", "question_id"]).select(F.lit(name).alias("strategy"), F.lit(scorer).alias("scorer"), "corpus", "question_id", "relevant", "recall", "ndcg")
            out = part if out is None else out.unionByName(part)
    return out


def own_corpora(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(corpora(), "corpus string, document_id string, text string")


def own_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q.corpus, q.question_id, q.query, list(q.evidence)) for q in fixtures.QUESTIONS], "corpus string, question_id string, query string, evidence array<string>")

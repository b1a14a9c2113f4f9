"""N-gram Jaccard self-join by MinHash banding (operator 2)."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import Scratch, components, drop_rows
from ._text import column, gram_sets, mix, slices, spans, word_hashes

N = 3
THRESHOLD = 0.5
RECALL = 0.95
ROWS = 4
CELL_DOCS = 4000
CELL_GRAMS = 1_000_000
CELLS, DENSE = 1 << 20, 256  # of a block of the counts of common grams, and grams multiplied at once


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with the target recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _signatures(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each non-empty set; shape (sets, bands)."""
    multipliers = np.random.default_rng(7).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.empty((len(at), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(at), b + 1, np.uint64)
        for m in multipliers[b * rows : (b + 1) * rows]:
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(grams * m, at))
        keys[:, b] = acc
    return keys


def _sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    starts, _, first = spans(buf, offs)
    return gram_sets(word_hashes(buf, starts), first, n)


def _prints(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a whole set: equal sets have equal ones."""
    return np.add.reduceat(mix(grams ^ np.uint64(0xA5A5)), at).view(np.int64), np.bitwise_xor.reduceat(mix(grams ^ np.uint64(0x5A5A5A)), at).view(np.int64)


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, cell_docs: int = CELL_DOCS, cell_grams: int = CELL_GRAMS) -> DataFrame:
    """Rows (doc_id, class_id, copy_of, links), one for each document.

    Two documents are joined if their sets of lower-case word n-grams have Jaccard similarity >= threshold.
    links is the number of other documents that a document is joined to, in the whole join: equal sets and
    all pairs of different ones.  class_id is the least doc_id of the document's connected group, copy_of the
    least doc_id with the very same set.  Documents of equal sets are verified once, as one node with its number of
    copies, so a thousand copies are a thousand rows here and not half a million pairs.

    The number of bands follows from the target recall at the threshold.  Within a bucket each node is linked with
    the bucket's first only, so the shuffle grows with the documents; linked nodes form components, and every pair
    of a component is verified on full n-gram sets.  A component of more than cell_docs nodes or cell_grams grams
    is cut into blocks, by the binary logarithm of the set's size and then by hash, each written once to the shared
    folder; a task reads two blocks and gives counts and a spanning forest, never pairs.  Blocks whose sizes rule the
    threshold out do not meet.  No group is too large for a task, none is cut, and nothing is sent twice.

    A row's document is its (doc_id, set): repeated rows count once, a repeated id with another set is another
    document.  Rows whose id is null have no row here; a null text, or one without a word, is joined to nothing and
    has one row of its own class for each id.  A text of fewer than n words has one gram, all its words.  doc_id may be of any type
    that can be ordered.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    bands = bands_for(threshold, recall, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text")).where("doc_id IS NOT NULL")

    def sign(batches):
        for b in batches:
            ids, col = column(b, "doc_id"), column(b, "text")
            for lo, hi, buf, offs in slices(col):
                grams, at = _sets(buf, offs, n)
                size = np.diff(at)
                some = np.flatnonzero(size)
                keys, p, q, count = np.zeros((0, bands), np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                if len(some):
                    keys = _signatures(grams, at[:-1][some], bands, rows).view(np.int64)
                    p[some], q[some] = _prints(grams, at[:-1][some])
                count[some] = bands
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(p), pa.array(q), pa.array(size.astype(np.int64)), flat], ["doc_id", "p", "q", "n", "bands"])

    signed = scratch.table(texts.mapInArrow(sign, f"doc_id {kind}, p long, q long, n long, bands array<long>"), "signed")
    same = ["p", "q", "n"]
    members = signed.select("doc_id", *same).distinct()
    copies = members.where("n > 0").groupBy(*same).agg(F.count("*").alias("copies"))
    nodes = signed.where("n > 0").groupBy(*same).agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r")).join(copies.hint("merge"), same)
    nodes = scratch.table(nodes.select(F.monotonically_increasing_id().alias("node"), *same, "copies", F.col("r.doc_id").alias("rep"), "r.bands"), "nodes")

    buckets = nodes.select("node", F.explode("bands").alias("key")).repartition("key").sortWithinPartitions("key", "node")

    def link(batches):
        last_key, hub = None, None
        for b in batches:
            key, node = column(b, "key").to_numpy(), column(b, "node").to_numpy()
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hubs = np.where(at >= 0, node[np.maximum(at, 0)], hub if hub is not None else 0)
            yield pa.RecordBatch.from_arrays([pa.array(hubs[~new]), pa.array(node[~new])], ["a", "b"])
            last_key, hub = key[-1], int(hubs[-1])

    comp = components(scratch, buckets.mapInArrow(link, "a long, b long").distinct(), "comp")
    comp = scratch.table(nodes.drop("bands").join(comp.withColumnRenamed("id", "node"), "node"), "members")
    linked = _links(scratch, texts, comp, n, threshold, cell_docs, cell_grams)

    node_rows = nodes.drop("bands").join(linked, "node", "left").select(*same, "copies", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    joined = members.where("n > 0").join(node_rows, same).select("doc_id", "class_id", F.col("rep").alias("copy_of"), (F.col("links") + F.col("copies") - 1).alias("links"))
    blank = members.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("links"))
    return joined.unionByName(blank)


def _links(scratch: Scratch, texts: DataFrame, comp: DataFrame, n: int, threshold: float, cell_docs: int, cell_grams: int) -> DataFrame:
    """Rows (node, links, class_id) of the nodes of components: the documents that other nodes joined to it stand for, and the least rep of its group."""
    level = lambda c: F.floor(F.log(F.col(c)) / math.log(1 / threshold) + 1e-9).cast("int")
    blocks_of = lambda: F.greatest(F.ceil(F.count("*") / cell_docs), F.ceil(F.sum("n") / cell_grams)).cast("int")
    whole = comp.groupBy("comp").agg(blocks_of().alias("cells"))
    comp = comp.join(whole, "comp").withColumn("level", F.when(F.col("cells") > 1, level("n")).otherwise(-1))
    parts = scratch.table(comp.where("cells > 1").groupBy("comp", "level").agg(blocks_of().alias("blocks")), "blocks")
    comp = comp.join(parts, ["comp", "level"], "left").withColumn("block", F.when(F.col("cells") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int"))
    # one text row for each wanted document, then to its cell; equal (id, text) rows meet here
    wanted = comp.select(F.col("rep").alias("_id"), "p", "q", "node", "copies", "comp", "level", "block").hint("merge")
    sent = texts.where("text IS NOT NULL").join(wanted, F.col("doc_id") == F.col("_id")).drop("doc_id", "_id")
    folder = scratch.path("cells")

    def cell(batches):
        for key, group in _groups(batches, ["comp", "level", "block"]):
            node, copies, sets = _read_cell(group, n)
            if key[1] < 0:
                yield _result(*_verified(node, copies, sets, node, copies, sets, threshold, True))
            else:
                _put_cell(folder, key, node, copies, sets)
                yield _result(node, np.zeros(len(node), np.int64), node)  # a node without links is its own root

    first = scratch.table(sent.repartition("comp", "level", "block").sortWithinPartitions("comp", "level", "block", "node").mapInArrow(cell, _FOUND), "found")

    roots, found = first.select("node", "root"), first
    if parts.limit(1).count():  # components of several blocks
        more = scratch.table(_pairs(parts).mapInArrow(_meet(folder, threshold), _FOUND), "met")
        large = components(scratch, more.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "large")
        roots = first.join(large.select(F.col("id").alias("node"), F.col("comp").alias("merged")), "node", "left").select("node", F.coalesce("merged", "root").alias("root"))
        found = first.unionByName(more).groupBy("node").agg(F.sum("links").alias("links"))
    least = roots.join(comp.select("node", "rep"), "node")
    least = least.join(least.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("node", "class_id")
    return found.select("node", "links").join(least, "node")


def _pairs(parts: DataFrame) -> DataFrame:
    """The pairs of blocks of each component that can hold pairs of sets above the threshold: those of one level or of two adjacent ones."""
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    here, there = parts.select("comp", "level", each.alias("block")), parts.select("comp", F.col("level").alias("other_level"), "blocks")
    pairs = here.join(there, "comp").where("other_level IN (level, level + 1)").select("comp", "level", "block", "other_level", each.alias("other"))
    return pairs.where("other_level > level OR other >= block").repartition("comp", "level", "block", "other_level", "other")


def _meet(folder: str, threshold: float):
    def meet(batches):
        for b in batches:
            for r in b.to_pylist():
                x = _get_cell(folder, (r["comp"], r["level"], r["block"]))
                same = (r["level"], r["block"]) == (r["other_level"], r["other"])
                y = x if same else _get_cell(folder, (r["comp"], r["other_level"], r["other"]))
                yield _result(*_verified(*x, *y, threshold, same))

    return meet


_FOUND = "node long, links long, root long"


def _result(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], ["node", "links", "root"])


def _groups(batches, keys):
    """Consecutive rows of equal keys, across batches, as (key, table)."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [column(b, k).to_numpy() for k in keys]
        cut = np.zeros(b.num_rows, bool)
        cut[0] = True
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(cut)
        for lo, hi in zip(at, np.append(at[1:], b.num_rows)):
            key = tuple(int(c[lo]) for c in cols)
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


Sets = tuple[np.ndarray, np.ndarray]  # grams one set after the other, and the offsets of the sets


def _read_cell(group: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, Sets]:
    """The nodes of a cell, their copies and their sets; rows that have the id of a node but another text are left out."""
    group = group.combine_chunks()
    texts = group["text"].chunk(0) if group.num_rows else pa.array([], pa.string())
    p, q, node, copies = (group[k].to_numpy() for k in ("p", "q", "node", "copies"))
    grams, length, rows = [], [], []
    seen: set[int] = set()
    for lo, hi, buf, offs in slices(texts):
        g, at = _sets(buf, offs, n)
        some = np.flatnonzero(np.diff(at))
        a, b = _prints(g, at[:-1][some]) if len(some) else (np.zeros(0, np.int64),) * 2
        for k in some[(a == p[lo:hi][some]) & (b == q[lo:hi][some])]:
            if node[lo + k] not in seen:
                seen.add(node[lo + k])
                rows.append(lo + k)
                grams.append(g[at[k] : at[k + 1]])
                length.append(at[k + 1] - at[k])
    return node[rows], copies[rows], (np.concatenate(grams or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(length)]).astype(np.int64))


def _put_cell(folder: str, key: tuple, node: np.ndarray, copies: np.ndarray, sets: Sets) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    path = f"{root}/{'_'.join(map(str, key))}"
    part = f"{path}.{uuid.uuid4().hex}"  # a repeated task's file replaces the whole file
    with fs.open_output_stream(part) as f:
        for x in (np.array([len(node), len(sets[0])]), node, copies, sets[1], sets[0]):
            f.write(np.ascontiguousarray(x).tobytes())
    fs.move(part, path)


def _get_cell(folder: str, key: tuple) -> tuple[np.ndarray, np.ndarray, Sets]:
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{'_'.join(map(str, key))}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:  # no text of the block's nodes was there
        return np.zeros(0, np.int64), np.zeros(0, np.int64), (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    with fs.open_input_stream(path) as f:
        raw = np.frombuffer(f.read(), np.int64)
    n = int(raw[0])
    return raw[2 : 2 + n], raw[2 + n : 2 + 2 * n], (raw[3 + 3 * n :].view(np.uint64), raw[2 + 2 * n : 3 + 3 * n])


def _verified(node_x, copies_x, x: Sets, node_y, copies_y, y: Sets, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the nodes of two cells, from every pair of one of each (same: of the one cell): root is a node of the same connected group."""
    nx, ny = len(node_x), len(node_y)
    node, weight = (node_x, copies_x) if same else (np.concatenate([node_x, node_y]), np.concatenate([copies_x, copies_y]))
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    if not nx or not ny or same and nx < 2:
        return node, links, node.copy()
    size_x, size_y = np.diff(x[1]), np.diff(y[1])
    gx, ox, gy, oy = x[0], np.repeat(np.arange(nx), size_x), y[0], np.repeat(np.arange(ny), size_y)
    # grams of both sides as columns 0, 1, ...; others can't be common
    both = np.intersect1d(gx, gy) if not same else _repeated(gx)
    cx, cy = _places(both, gx), _places(both, gy)
    ox, cx, oy, cy = ox[cx >= 0], cx[cx >= 0], oy[cy >= 0], cy[cy >= 0]
    order_y = np.argsort(cy, kind="stable")
    oy = oy[order_y]
    at_y = np.searchsorted(cy[order_y], np.arange(len(both) + 1))
    often = np.bincount(cx, minlength=len(both)) * np.diff(at_y) > nx * ny // 30  # by matrix products, the others pair by pair
    dense = np.full(len(both), -1)
    dense[often] = np.arange(often.sum())
    step = max(1, min(nx, CELLS // max(1, ny)))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    begin_x = np.searchsorted(ox, np.arange(0, nx + step, step))
    base = 0 if same else nx
    dense_y = None
    if often.any():
        dy = np.repeat(np.arange(len(both)), np.diff(at_y))
        dense_y = dense[dy], oy
    for k, lo in enumerate(range(0, nx, step)):
        hi = min(nx, lo + step)
        o, c = ox[begin_x[k] : begin_x[k + 1]] - lo, cx[begin_x[k] : begin_x[k + 1]]
        common = np.zeros((hi - lo, ny), np.float32)
        if dense_y is not None:
            for a in range(0, int(often.sum()), DENSE):
                left, right = np.zeros((hi - lo, DENSE), np.float32), np.zeros((DENSE, ny), np.float32)
                d = dense[c] - a
                m = (d >= 0) & (d < DENSE)
                left[o[m], d[m]] = 1
                d = dense_y[0] - a
                m = (d >= 0) & (d < DENSE)
                right[d[m], dense_y[1][m]] = 1
                common += left @ right
        o, c = o[~often[c]], c[~often[c]]
        width = at_y[c + 1] - at_y[c]
        cuts = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()) + CELLS, CELLS))
        for a, z in zip(cuts, cuts[1:]):
            w = width[a:z]
            if len(w):
                row = np.repeat(o[a:z], w)
                col = oy[np.repeat(at_y[c[a:z]] - np.cumsum(w) + w, w) + np.arange(w.sum())]
                common += np.bincount(row * ny + col, minlength=common.size).reshape(common.shape).astype(np.float32)
        union = (size_x[lo:hi, None] + size_y[None, :]).astype(np.float64)
        union -= common
        ok = common / union >= threshold
        if same:
            ok[np.arange(hi - lo), np.arange(lo, hi)] = False
        links[lo:hi] += (ok @ copies_y.astype(np.float64)).astype(np.int64)
        if not same:
            links[base:] += (copies_x[lo:hi].astype(np.float64) @ ok).astype(np.int64)
        i, j = np.nonzero(ok)
        edges.append((i + lo, j + base))
        root = _joined(root, edges.pop())
    return node, links, node[root]


def _repeated(grams: np.ndarray) -> np.ndarray:
    """The grams that occur twice."""
    s = np.sort(grams)
    return np.unique(s[1:][s[1:] == s[:-1]])


def _places(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands, -1 if nowhere."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def _joined(root: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Roots after the edges have been added: the least place of each group."""
    i, j = edges
    while len(i):
        low = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, root[i], low)
        np.minimum.at(now, root[j], low)
        while (now[now] != now).any():
            now = now[now]
        now = now[root]
        if (now == root).all():
            break
        root = now
    return root


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document, that of the least doc_id, of each group of near duplicates.

    Documents of a null id or text, or without a word, stay.  Repeated rows of a kept id stay, and an id that is
    repeated with other texts stays with all of them if it is the least of one of its groups: no group loses all its rows.
    """
    groups = near_duplicates(docs, **how).groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("class_id")).alias("copy"))
    return drop_rows(docs, groups.where("copy"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM words
), reps AS (
  SELECT s, min(doc_id) AS rep, count(*) AS copies FROM sets WHERE s IS NOT NULL GROUP BY s
), grams AS (
  SELECT rep, copies, len(s) AS n, unnest(s) AS g FROM reps
), near AS (
  SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5
), reach(a, b) AS (
  SELECT rep, rep FROM reps UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a
), class AS (
  SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS rep, sum(copies) AS links FROM near GROUP BY a
)
SELECT doc_id, class_id, rep AS copy_of, (coalesce(links, 0) + copies - 1)::BIGINT AS links FROM sets JOIN reps USING (s) JOIN class USING (rep) LEFT JOIN degree USING (rep)
UNION ALL
SELECT doc_id, doc_id, doc_id, 0 FROM sets WHERE s IS NULL
"""

"""The ten operators against brute force, and on awkward tables."""

import gzip
import collections
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from chunkloom.llm import block_names, decontaminate, hmm, ngram_join, packing, quality, secret_scan, sharding, suffixes, warc
from chunkloom.llm._dist import Scratch, components
from chunkloom.llm._text import chain, gram_sets, raw, spans, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, extra=False):
    """texts: (doc_id, text) pairs; extra adds columns that operators use as names of their own."""
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None) for i, t in texts] or [], DOCS)
    if extra:
        for name in ("uid", "name", "row", "key", "_id", "shard", "_key", "level", "block", "bin", "length", "start", "score", "node", "comp", "print", "words", "y", "_drop", "_pid"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def words(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


LONG = words(99, 30_000)
AWKWARD = [(1, "same text here"), (2, "same text here"), (2, "same text here"), (None, "same text here"), (3, None), (None, None), (4, ""), (5, ""), (6, "  \n "), (7, "x"), (8, LONG), (9, LONG), (10, LONG + " end"), (7, "another text of id seven")]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD, extra=True)


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, rng.randrange(2), rng.randrange(2)) for i in range(1, 11)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


def test_every_operator_on_awkward_and_empty_tables(spark, awkward, labels):
    bench = spark.createDataFrame([(1, "same text here"), (2, None), (3, ""), (None, LONG[:200])], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a\r\nX: y", "<p>ü"), (None, None, None), (1, "http://a\r\nX: y", "<p>ü")], "page_id long, url string, html string")
    runs = {
        "quality": lambda d: quality.quality_scores(d, labels),
        "join": ngram_join.near_duplicates,
        "packing": packing.packed,
        "names": block_names.exact_duplicates,
        "secrets": secret_scan.scan,
        "shards": sharding.shards,
        "suffixes": suffixes.repeated_passages,
        "leaks": lambda d: decontaminate.leaks(d, bench),
        "hmm": lambda d: hmm.language_model_scores(d, states=2, rounds=1),
        "keep_first": block_names.keep_first,
        "keep_one": ngram_join.keep_one,
        "clean": lambda d: decontaminate.clean(d, bench),
    }
    empty = table(spark, [])
    got = {}
    for name, f in runs.items():
        got[name] = f(awkward).collect()
        assert f(empty).count() == 0, name
    assert warc.normalised_pages(pages.limit(0)).count() == 0
    n = len(AWKWARD)
    assert len(got["quality"]) == len(got["names"]) == len(got["shards"]) == len(got["hmm"]) == n
    assert all(r.score is None and not r.keep for r in got["quality"] if r.doc_id in (3, 4, 5, 6))
    assert sum(r.length for r in got["packing"]) == sum(len((t or "").split()) for _, t in AWKWARD)
    assert {(r.doc_id, r.n_words) for r in got["hmm"]} >= {(3, 0), (4, 0), (6, 0), (7, 1), (8, 30_000)}
    joined = {(r.doc_id, r.class_id, r.copy_of, r.links) for r in got["join"]}
    assert joined == {(1, 1, 1, 1), (2, 1, 1, 1), (7, 7, 7, 0), (8, 8, 8, 2), (9, 8, 8, 2), (10, 8, 10, 2)} | {(i, i, i, 0) for i in (3, 4, 5, 6)} and len(got["join"]) == 11
    assert {r.doc_id for r in got["suffixes"]} == {8, 9, 10}
    assert {(r.doc_id, r.item_id) for r in got["leaks"]} == {(1, 1), (2, 1), (None, 1), (8, None), (9, None), (10, None)}
    kept = sorted((r.doc_id or 0, r.text) for r in got["keep_first"] if r.text is not None)
    assert kept == sorted([(1, "same text here"), (4, ""), (6, "  \n "), (7, "x"), (7, "another text of id seven"), (8, LONG), (10, LONG + " end")])
    assert sum(r.text is None for r in got["keep_first"]) == 2
    assert {r.doc_id for r in got["keep_one"]} == {1, None, 3, 4, 5, 6, 7, 8}
    assert {r.doc_id for r in got["clean"]} == {3, None, 4, 5, 6, 7}
    assert all(r.asDict().keys() >= {"uid", "node", "_drop"} for r in got["keep_first"] + got["keep_one"] + got["clean"])


# --- 1 ----------------------------------------------------------------------


def test_scores_are_density_differences():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) * (1 + y[:, None]) + y[:, None]
    m = quality.fit(x, y, np.zeros(0, np.uint64))
    z = (x - m.centre) / m.scale
    for k in range(3):
        cov = m.factors[k] @ m.factors[k].T
        d = z - m.means[k]
        want = np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        assert np.allclose(m.densities(x)[:, k], want)
    assert np.allclose(m.scores(x), m.densities(x)[:, 0] - m.densities(x)[:, 1:].max(1))


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(900):
        kind = i % 3
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randrange(400)}" for _ in range(rng.randrange(30, 200))]
        if kind == 1:
            w = [x.upper() + "!!" for x in w[:10] * 8]
        if kind == 2:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyone", "nastytwo"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(kind != 1), int(kind == 2)))
    docs, held = table(spark, rows[:600]), table(spark, rows[600:])
    model = quality.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert len(model.lexicon) == 2
    got = {r.doc_id: r.label for r in quality.score_with(held, model).collect()}
    right = sum(got[i] == quality.CLASSES[i % 3] for i in range(600, 900))
    assert right >= 291
    assert {r.doc_id for r in quality.keep_clean(held, model).collect()} == {r.doc_id for r in quality.score_with(held, model).where("keep").collect()}


def test_a_document_labelled_twice_has_the_worst_label(spark):
    docs = table(spark, [(i, words(i, 30)) for i in range(60)])
    rows = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(0, 40)] + [(i, 1, 1) for i in range(20)]
    models = []
    for seed, parts in ((1, 1), (2, 5), (3, 3)):
        random.Random(seed).shuffle(rows)
        models.append(quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int").repartition(parts)))
    assert all(np.array_equal(m.means, models[0].means) and np.array_equal(m.factors, models[0].factors) for m in models)
    assert np.allclose(np.exp(models[0].log_prior), 1 / 3)


def test_marks_and_lengths_of_lexicon_words():
    lexicon = hmm.word_hashes(*(lambda b: (b, spans(b, np.array([0, len(b)]))[0]))(np.frombuffer(b"bad q " + b"x" * 100, np.uint8)))
    texts = ["bad", "Bad!!!!!!!", "bad.,;:!?#$%&*", "q?", "badly", "b.ad", "!!!!", "x" * 100 + "!", "bad fine bad. q", ""]
    at = quality.FEATURES.index("lexicon")
    assert np.expm1(quality.statistics(pa.array(texts), np.sort(lexicon))[:, at]).round().astype(int).tolist() == [1, 1, 1, 1, 0, 0, 0, 1, 3, 0]


def plain_statistics(text, lexicon):
    """The statistics of a text, character by character."""
    w, n = text.split(), max(1, len(text.encode()))
    if not w:
        return [0.0] * len(quality.FEATURES)
    low = [x.encode().lower() for x in w]
    count = collections.Counter(low)
    raw_ = text.encode()
    some = lambda chars: sum(chr(b) in chars for b in raw_)
    symbols, stops = "#$%&*@^~|<>{}[]\\_=+/", ".,;:!?"
    return [
        np.log1p(len(w)), np.log1p((n - sum(b == 195 for b in raw_)) / len(w)), np.sqrt(some("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n), np.sqrt(some("0123456789") / n), np.sqrt(some(symbols) / n), np.sqrt(some(stops) / len(w)),
        np.log1p(len(w) / (text.count("\n") + 1)), np.log1p(len(count)) / np.log1p(len(w)), np.sqrt(max(count.values()) / len(w)), np.sqrt(sum(chr(x[-1]) in symbols for x in low) / len(w)),
        np.log1p(sum(x.decode() in lexicon or x.decode().rstrip(quality.MARKS) in lexicon for x in low)),
    ]


def test_statistics_equal_plain_ones():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ABé1#.!\n\t") for _ in range(rng.randrange(200))) for _ in range(200)] + ["", "a", "  "]
    lexicon = {"a", "bé", "cab"}
    buf = np.frombuffer("\n".join(sorted(lexicon)).encode(), np.uint8)
    got = quality.statistics(pa.array(texts), np.sort(word_hashes(buf, spans(buf, np.array([0, len(buf)]))[0])))
    assert np.allclose(got, [plain_statistics(t, lexicon) for t in texts])


# --- 2 ----------------------------------------------------------------------


def grams(text, n=3):
    w = text.lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_join_finds_the_pairs_of_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for k in range(60):
        base = words(k, rng.randrange(4, 120), 5000).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = [w if rng.random() > rng.choice([0, 0.03, 0.08]) else f"e{rng.randrange(10**6)}" for w in base]
            texts.append(" ".join(copy))
    docs = table(spark, list(enumerate(texts)))
    want = brute_classes(texts)
    for how in ({}, {"cell_docs": 2}, {"cell_grams": 150}):  # components of several blocks
        got = {r.doc_id: (r.class_id, r.copy_of, r.links) for r in ngram_join.near_duplicates(docs, **how).collect()}
        assert sum(got[i] != want[i] for i in range(len(texts))) <= 0.05 * len(texts) and got.keys() == set(range(len(texts)))
        assert all(got[i][1] == want[i][1] and got[i][2] <= want[i][2] for i in got) and sum(w[2] for w in want) > 100
    named = docs.selectExpr("concat('d', lpad(doc_id, 3, '0')) AS doc_id", "text")  # ids that aren't numbers
    assert {(int(r.doc_id[1:]), int(r.class_id[1:]), r.links) for r in ngram_join.near_duplicates(named).collect()} == {(i, g[0], g[2]) for i, g in ((r.doc_id, (r.class_id, r.copy_of, r.links)) for r in ngram_join.near_duplicates(docs).collect())}


def brute_classes(texts):
    """(class, copy_of, links) of each text, from all pairs."""
    sets = [grams(t) for t in texts]
    first = {}
    copy = [first.setdefault(frozenset(s), i) for i, s in enumerate(sets)]
    near = [[j for j in range(len(texts)) if j != i and len(sets[i] & sets[j]) >= ngram_join.THRESHOLD * len(sets[i] | sets[j]) > 0] for i in range(len(texts))]
    group = list(range(len(texts)))
    for _ in texts:
        group = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(texts))]
    return [(group[i], copy[i], len(near[i])) for i in range(len(texts))]


def test_a_component_of_twenty_thousand_texts(spark):
    """Every text shares 40 words with every other: one class, each joined to all others; blocks and levels lose no link."""
    base = words(1, 40, 10**6)
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"concat('{base} x', id, ' y', id % 7) AS text")
    got = ngram_join.near_duplicates(docs).groupBy("class_id", "links").count().collect()
    assert [(r.class_id, r.links, r["count"]) for r in got] == [(0, 19_999, 20_000)]


def test_an_id_with_two_texts_keeps_a_row_of_each_group(spark):
    a, b = words(5, 30), words(6, 30)
    docs = table(spark, [(1, a), (2, a), (2, b), (3, b), (4, b + " more")])
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [1, 2, 2]


def test_a_phrase_in_the_midst_of_many_texts_is_cut_until_its_collections_fit(spark):
    phrase, shared = words(1, 16, 10**6), words(2, 12, 10**6)
    texts = [" ".join([words(10 + i, 30, 10**6), *([shared] if i % 50 == 0 else []), phrase, words(5000 + i, 30, 10**6)]) for i in range(400)]
    docs = table(spark, list(enumerate(texts)))
    want = {tuple(r) for r in suffixes.repeated_passages(docs, length=20, seed=8).collect()}
    got = {tuple(r) for r in suffixes.repeated_passages(docs, length=20, seed=8, collection=300).collect()}
    assert got == want and {r[0] for r in want} == set(range(0, 400, 50)) and all(r[2] - r[1] >= 28 for r in want)
    with pytest.raises(TypeError):
        suffixes.repeated_passages(docs.selectExpr("'a' AS doc_id", "text"))


def test_gram_sets_and_chains():
    buf, offs = raw(pa.array(["a b c d a b c", "", None, "a b", "a b c"]))
    starts, _, first = spans(buf, offs)
    g, at = gram_sets(word_hashes(buf, starts), first, 3)
    assert np.diff(at).tolist() == [4, 0, 0, 1, 1]
    assert len(set(g[at[4] : at[5]]) & set(g[: at[1]])) == 1
    h = np.arange(50, dtype=np.uint64) ** np.uint64(3)
    for n in (2, 3, 7, 16):
        assert [int(chain(h[i : i + n], n)[0]) for i in range(50 - n + 1)] == chain(h, n).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 201)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.comp for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


# --- 3 ----------------------------------------------------------------------


def test_records_survive_the_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("ab<>ü\r\n") for _ in range(rng.choice([0, 10, 5000, 400_000])))) for i in range(25)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.normalised_pages(pages).collect()
    assert sorted(r.page_id for r in index) == list(range(25)) and all(r.status == "ok" for r in index)
    by = {r[0]: r for r in rows}
    for r in index:
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            member = gzip.decompress(f.read(r.length))
        head, _, body = member.partition(b"\r\n\r\n")
        payload = by[r.page_id][2].encode()
        assert body == payload + b"\r\n\r\n" and f"WARC-Target-URI: {r.url}".encode() in head and r.payload_bytes == len(payload)
    for name in {r.file for r in index}:
        assert sum(1 for _ in open(name + ".idx")) == sum(r.file == name for r in index)
        assert gzip.open(name).read().count(b"WARC/1.0\r\n") >= sum(r.file == name for r in index)


def test_broken_files(spark, tmp_path):
    record = warc.header(1, "u", 5) + b"hello\r\n\r\n"
    whole = gzip.compress(record * 3)
    cases = {"mono": (whole, ["ok"] * 3), "members": (gzip.compress(record) * 2, ["ok"] * 2), "plain": (record * 2, ["ok"] * 2), "cut": (gzip.compress(record * 2 + record[:-8]), ["ok", "ok", "truncated"]), "broken": (whole[:-12], ["ok", "truncated"]), "empty": (b"", []), "junk": (gzip.compress(b"no record at all"), ["truncated"])}
    for name, (raw_, _) in cases.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(raw_)
    got = warc.normalise(spark, [f"file://{tmp_path}/{n}.warc.gz" for n in cases], f"file://{tmp_path}/out").collect()
    for name, (_, want) in cases.items():
        found = [r.status for r in sorted((r for r in got if f"/{name}." in r.file), key=lambda r: r.record)]
        assert found == want, name
    assert warc.normalise(spark, [], f"file://{tmp_path}/out").count() == 0


# --- 4 ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 300, 20_000])
def test_plans_place_every_piece_and_fill_no_bin_over(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(100, np.maximum(1, rng.lognormal(2.6, 1.1, n).astype(int)))
    histogram = {int(s): int(c) for s, c in zip(*np.unique(lengths, return_counts=True))}
    p = packing.plan(histogram, 100)
    load = np.zeros(p.bins, int)
    for s, moves in p.moves.items():
        assert sorted(itertools.chain(*(range(r, r + c) for r, c, _ in moves))) == list(range(histogram[s]))
        for _, c, b in moves:
            load[b : b + c] += s
    assert load.max(initial=0) <= 100 and (load > 0).all()
    if n >= 300:
        assert p.bins <= 1.03 * lengths.sum() / 100 + 2


def test_packed_documents(spark):
    rng = random.Random(2)
    texts = [(i, words(i, rng.choice([1, 3, 20, 60, 99, 100, 101, 350]))) for i in range(150)]
    got = packing.packed(table(spark, texts), capacity=100).collect()
    load, seen = {}, {}
    for r in got:
        load[r.bin] = load.get(r.bin, 0) + r.length
        seen.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    total = sum(len(t.split()) for _, t in texts)
    assert max(load.values()) <= 100 and sum(load.values()) == total and len(load) <= 1.05 * total / 100 + 1
    for i, t in texts:
        parts = sorted(seen[i])
        assert parts[0][0] == 0 and parts[-1][1] == len(t.split()) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


# --- 5 ----------------------------------------------------------------------


def random_model(states, symbols, seed=3):
    rng = np.random.default_rng(seed)
    share = lambda x, axis=-1: x / x.sum(axis, keepdims=True)
    return hmm.Model(share(rng.random(states)), share(rng.random((states, states))), share(rng.random((symbols, states)), 0))


def test_forward_and_counts_equal_sums_over_paths():
    m = random_model(3, 16)
    length = np.array([5, 0, 0, 1, 6])
    first = np.concatenate([[0], np.cumsum(length)])
    sym = np.random.default_rng(1).integers(0, 16, 12).astype(np.int32)
    ll, start, steps = np.zeros(5), np.zeros(3), np.zeros((3, 3))
    for d, (a, b) in enumerate(zip(first, first[1:])):
        total, i0, t0 = 0, np.zeros(3), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a) if b > a else ():
            p = m.initial[path[0]] * m.emit[sym[a], path[0]]
            for k in range(1, b - a):
                p *= m.step[path[k - 1], path[k]] * m.emit[sym[a + k], path[k]]
            total += p
            i0[path[0]] += p
            for k in range(1, b - a):
                t0[path[k - 1], path[k]] += p
        if b > a:
            ll[d] = np.log(total)
            start += i0 / total
            steps += t0 / total
    assert np.allclose(hmm.likelihoods(m, sym, first[:-1], length), ll)
    emit, i, t, total = hmm._expected(m, sym, first[:-1], length)
    assert np.allclose(i, start) and np.allclose(t, steps) and np.allclose(emit.sum(1), np.bincount(sym, minlength=16)) and total == pytest.approx(ll.sum())


def test_long_texts_by_stretches_are_as_whole_ones(monkeypatch):
    m = random_model(4, 50)
    length = np.array([3, 1000, 77, 64, 65, 1])
    sym = np.random.default_rng(2).integers(0, 50, length.sum()).astype(np.int32)
    begin = np.cumsum(length) - length
    want, counts = hmm.likelihoods(m, sym, begin, length), hmm._expected(m, sym, begin, length)
    monkeypatch.setattr(hmm, "LONG", 10)
    monkeypatch.setattr(hmm, "STRETCH", 32)
    assert np.allclose(hmm.likelihoods(m, sym, begin, length), want, rtol=1e-12)
    assert all(np.allclose(a, b) for a, b in zip(hmm._expected(m, sym, begin, length), counts))


def test_a_text_of_two_million_words_fits_in_little_memory():
    m = random_model(8, 1000)
    sym = np.random.default_rng(2).integers(0, 1000, 2_000_000).astype(np.int32)
    tracemalloc.start()
    hmm._expected(m, sym, np.array([0]), np.array([len(sym)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20  # whole, three arrays of eight numbers a word alone are 384 MB


def test_every_word_has_its_own_emissions(spark):
    names = [f"w{i}" for i in range(90_000)]
    docs = [(i, " ".join([names[0]] * 20)) for i in range(50)] + [(100 + i, " ".join(names[k : k + 1000])) for i, k in enumerate(range(1, 90_000, 1000))] + [(200, names[77]), (201, names[0])]
    got = {r.doc_id: r.bits_per_word for r in hmm.language_model_scores(table(spark, docs), states=2, rounds=1).collect()}
    assert len(got) == len(docs) and got[200] > got[201] + 4


def test_blocks_and_partitions_do_not_change_the_model(spark, monkeypatch):
    texts = [(i, words(i, 40, 30)) for i in range(60)] + [(60, None), (None, ""), (61, "seen once here only")]
    docs = table(spark, texts)
    once = lambda n: {r.doc_id: r.log_likelihood for r in hmm.language_model_scores(docs.repartition(n), states=3, rounds=2).collect()}
    one, many = once(1), once(7)
    assert one[60] == one[None] == 0 and one[0] < 0
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-4) for k in one)
    # the same rounds over all texts in memory
    order = [r.text for r in docs.selectExpr("text", "xxhash64(text) AS h").where("length(text) > 0").orderBy("h", "text").collect()]
    model, vocabulary, counts = hmm.start(pa.array(order), 3)
    hashes, first = hmm.word_hashes(raw(pa.array(order))[0], hmm.spans(*raw(pa.array(order)))[0]), hmm.spans(*raw(pa.array(order)))[2]
    ids, begin, length = np.searchsorted(vocabulary, hashes).astype(np.int32), first[:-1], np.diff(first)
    n = np.bincount(ids)
    seen = counts.sum(1)
    for _ in range(2):
        counts, initial, step, _ = hmm._expected(hmm.Model(model.initial, model.step, model.emissions(counts, seen)), ids, begin, length)
        model, seen = hmm.shape(initial, step, hmm.class_sums(counts, n)), n
    emit = model.emissions(counts, n)
    assert np.allclose(emit.sum(0) + hmm.PRIOR * model.share[0] / model.norm, 1)
    total = hmm._expected(hmm.Model(model.initial, model.step, emit), ids, begin, length)[3]
    assert sum(one.values()) == pytest.approx(total, rel=1e-4)


def test_held_out_texts_beat_a_unigram(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 60, 40))) for i in range(300)]  # two languages of 60 words
    rows = hmm.language_model_scores(table(spark, texts), states=4, learn="doc_id % 5 <> 0").collect()
    held = [r for r in rows if r.doc_id % 5 == 0]
    n = collections.Counter(w for i, t in texts if i % 5 for w in t.split())
    total = sum(n.values()) + len(n) + 1
    unigram = np.mean([-np.log2((n[w] + 1) / total) for i, t in texts if i % 5 == 0 for w in t.split()])
    assert len(rows) == 300 and np.mean([r.bits_per_word for r in held]) < unigram - 0.5


# --- 6 ----------------------------------------------------------------------


def test_names_are_equal_for_equal_texts_only(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 4, 5, 8, 9, 17]))) for _ in range(250)]
    got = block_names.identities(table(spark, list(enumerate(texts))).repartition(3), block_chars=4).collect()
    name = {r.doc_id: (r.level, r.name) for r in got}
    assert len(got) == 250
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(t, set()).add(name[i])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_names_of_texts_with_one_hash(spark, monkeypatch):
    """Were all hashes equal, values would still be told apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    rng = random.Random(16)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 6]))) for _ in range(300)]
    got = block_names.identities(table(spark, list(enumerate(texts))).repartition(3), block_chars=4).collect()
    assert len({(texts[r.doc_id], r.level, r.name) for r in got}) == len(set(texts)) == len({(r.level, r.name) for r in got})


# --- 7 ----------------------------------------------------------------------


def test_candidates_hold_every_match():
    rng = random.Random(8)
    patterns = [*secret_scan.RULES.values(), "ab(c|de)+f?g{2}", "(?i)TOKEN=[a-c]x", "x*", "(?:ab|c)d[ef]g", "[0-9]{4}", "a(?=bc)bcd", "abc|d", "ab[^c]de", "(abc){0,2}def"]
    alphabet = ["akia", "AKIA", "0", "A", "abc", "d", "e", "f", "g", "gg", "TOKEN=", "token=", "a", "x", "c", "://", "u", ":", "p", "@", "password: ", "12345678", "é", " ", "4" * 40]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(1500)]
    buf, offs = raw(pa.array(texts))
    for p in patterns:
        query = secret_scan.trigram_query(p)
        needed = np.zeros(1 << 24, bool)
        needed[sorted(secret_scan.wanted(query))] = True
        found = set(secret_scan.candidates(query, secret_scan.postings(buf, offs, needed), len(texts)).tolist())
        assert {i for i, t in enumerate(texts) if re.search(p, t, re.ASCII)} <= found, p
    assert secret_scan.trigram_query(r"\b[0-9a-f]{40}\b") == secret_scan.ALL != secret_scan.trigram_query(secret_scan.RULES["aws_access_key"])


# --- 8 ----------------------------------------------------------------------


def test_shards_are_ranges_of_bounded_size(spark):
    rng = random.Random(5)
    rows = [(i, "t" * rng.randrange(400), "en", "hot" if rng.random() < 0.6 else f"s{rng.randrange(9)}", 0) for i in range(1500)] + [(7777, "t" * 300, "en", "hot", 0)] * 60
    rng.shuffle(rows)
    out = sharding.shards(spark.createDataFrame(rows, DOCS).repartition(4), shard_bytes=8000, least=1, oversample=32)
    from pyspark.sql import functions as F

    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r[0], r[1]) for r in rows)
    parts, size, keys = {}, {}, {}
    for r in got:
        parts.setdefault(r.shard, set()).add(r.part)
        size[r.shard] = size.get(r.shard, 0) + len(r.text) + 1
        keys.setdefault(r.shard, []).append((r.source, r.doc_id))
    assert all(len(p) == 1 for p in parts.values()) and all(k == sorted(k) for k in keys.values())
    order = sorted(keys)
    assert all(max(keys[a]) <= min(keys[b]) for a, b in zip(order, order[1:]))
    assert max(size.values()) <= 1.5 * 8000 * 1.35 and len(order) >= sum(size.values()) / 12000


def test_awkward_rows_are_sharded_too(spark):
    rows = AWKWARD[:10] * 30 + [(7, "x")] * 200
    docs = table(spark, [r for r in rows if r[1] != LONG], extra=True).repartition(5)
    wild = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE concat('é', doc_id) END AS source", "uid", "shard", "_key")
    for d in (docs, wild):
        for size in (40, 300, 10**9):
            out = sharding.shards(d, shard_bytes=size, least=1)
            got = out.collect()
            plain = lambda rs: sorted(((r.doc_id, r.text, r.source) for r in rs), key=repr)
            assert plain(got) == plain(d.collect()) and set(out.columns) == set(d.columns)
            key = lambda r: ((r.source is not None, r.source or ""), (r.doc_id is not None, r.doc_id or 0))
            by = {}
            for r in got:
                by.setdefault(r.shard, []).append(key(r))
            order = sorted(by)
            assert all(max(by[a]) < min(by[b]) or max(by[a]) == min(by[b]) == max(by[b]) for a, b in zip(order, order[1:])) and (len(order) > 10 or size > 40) and (size < 10**9 or len(order) == 1)
            assert all(r.shards_disjoint for r in sharding.held(d, shard_bytes=size, least=1).collect())
    assert sharding.held(table(spark, [])).count() == 0


# --- 9 ----------------------------------------------------------------------


@pytest.mark.parametrize("in_memory", [8, 10**9])
def test_columns_equal_sorted_suffixes(tmp_path, in_memory):
    rng = np.random.default_rng(0)
    for _ in range(25):
        n = int(rng.integers(1, 10))
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 14, n))])
        sym = rng.integers(1, 4, first[-1])
        text, size, lcp, bwt = suffixes.build(sym, first, f"file://{tmp_path}/columns", in_memory)
        want = sorted(([*sym[first[i] + k : first[i + 1]].tolist(), i - 10**6], i, int(first[i + 1] - first[i] - k), int(sym[first[i] + k - 1]) if k else 0) for i in range(n) for k in range(first[i + 1] - first[i] + 1))
        common = [0] + [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1] and p[0] > 0, zip(a[0], b[0]))) for a, b in zip(want, want[1:])]
        assert [w[1] for w in want] == text.tolist() and [w[2] for w in want] == size.tolist() and [w[3] for w in want] == bwt.tolist() and common == lcp.tolist()
    assert not list(tmp_path.rglob("*-*")) or in_memory == 8


def test_passages_equal_brute_force(spark):
    rng = random.Random(9)
    shared = [words(1000 + k, 25, 10**6).split() for k in range(6)]
    texts = []
    for i in range(80):
        t = words(i, rng.randrange(5, 60), 10**6).split()
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(10)
            t[len(t) // 2 : len(t) // 2] = s[a : a + rng.randrange(6, 16)]
        texts.append(t)
    texts += [["again"] * 60, ["again"] * 9 + ["other"], texts[0]]
    where = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 9):
            where.setdefault(tuple(t[k : k + 10]), set()).add(i)
    want = set()
    for i, t in enumerate(texts):
        cover = sorted({j for k in range(len(t) - 9) if len(where[tuple(t[k : k + 10])]) > 1 for j in range(k, k + 10)})
        for _, g in itertools.groupby(enumerate(cover), lambda p: p[1] - p[0]):
            g = [x for _, x in g]
            want.add((i, g[0], g[-1] + 1, len(g)))
    docs = table(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]).repartition(3)
    for how in ({}, {"collection": 50, "in_memory": 40}, {"collection": 400}):  # with columns in files, and with keys cut again
        got = {tuple(r) for r in suffixes.repeated_passages(docs, length=10, seed=4, **how).collect()}
        assert got == want and len(want) > 20


# --- 10 ---------------------------------------------------------------------


def best_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def test_myers_and_pieces():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        want = best_distance(item, text)
        assert decontaminate.myers(item, text, len(item)) == want and decontaminate.myers(item, text, want - 1) is None
        e = decontaminate.budget_of(item, 0.2)
        assert "".join(p for _, p in decontaminate.pieces(item, e)) == item and len(decontaminate.pieces(item, e)) == e + 1


def test_within_one_error():
    rng = random.Random(4)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(n))) for n in (6, 8))
        want = min(lev(a, b[:k]) for k in range(len(b) + 1)) <= 1
        assert decontaminate.within_one(a, b) == want, (a, b)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return row[-1]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(k, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(3, 70)))) for k in range(30)]
    docs = []
    for i in range(60):
        t = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(150)))
        if i % 2:
            s = list(rng.choice(items)[1])
            for _ in range(rng.randrange(9)):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([[], [rng.choice("abcxyz")], [s[k], "z"]])
                s = s or ["a"]
            t = t[:40] + "".join(s) + t[40:]
        docs.append((i, t))
    norm = lambda t: " ".join(t.lower().split())
    want = {(i, k, d) for i, t in docs for k, s in items if norm(s) and (d := best_distance(norm(s), norm(t))) <= decontaminate.budget_of(norm(s), 0.15)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = table(spark, docs)
    for how in ({}, {"slice_chars": 300}):
        assert {tuple(r) for r in decontaminate.leaks(d, bench, 0.15, **how).collect()} == want
    assert len(want) > 30 and {r.doc_id for r in decontaminate.clean(d, bench, 0.15, 300).collect()} == {i for i, _ in docs} - {w[0] for w in want}

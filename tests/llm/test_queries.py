"""The registered queries against SQL, and the pipeline against a brute-force version of its stages."""

import itertools
import os

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from chunkloom.llm import decontaminate, ngram_join, packing, quality, queries

from .test_operators import grams

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(name):
    path = f"{SF}/{name}.parquet"
    return duckdb.sql(f"SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"SELECT * FROM read_parquet('{path}')")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        path = f"{SF}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    plain = lambda rs: sorted((tuple(map(value, r)) for r in rs), key=repr)
    assert plain(got.select(*columns).collect()) == plain(want)


def test_pipeline_equals_brute_force(spark):
    docs = {d: t for d, t in rows("documents").select("doc_id", "text").fetchall()}
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(docs)
    x = quality.statistics(pa.array([docs[i] for i in ids]), model.lexicon)
    z = (x - model.centre) / model.scale
    density = []
    for mean, low, prior in zip(model.means, model.factors, model.log_prior):
        inverse, d = np.linalg.inv(low @ low.T), z - mean
        density.append(prior - 0.5 * np.linalg.slogdet(low @ low.T)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, inverse, d))
    kept = {i: docs[i] for k, i in enumerate(ids) if docs[i].split() and density[0][k] >= max(density[1][k], density[2][k])}
    stages = [set(kept)]
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    kept = {i: t for t, i in first.items()}
    stages.append(set(kept))
    sets, parent = {i: grams(t) for i, t in kept.items()}, {i: i for i in kept}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(kept), 2):
        if len(sets[a] & sets[b]) >= ngram_join.THRESHOLD * len(sets[a] | sets[b]) > 0:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    kept = {i: t for i, t in kept.items() if root(i) == i}
    stages.append(set(kept))
    norm = lambda t: " ".join(t.lower().split())
    items = [norm(t) for _, t in rows("benchmark").select("item_id", "text").fetchall()]
    leak = lambda t: any(s in t or any(p in t for _, p in decontaminate.pieces(s, b)) and decontaminate.myers(s, t, b) is not None for s in items for b in [decontaminate.budget_of(s, decontaminate.ERROR_RATE)])
    kept = {i: t for i, t in kept.items() if not leak(norm(t))}
    stages.append(set(kept))

    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = table.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        out = stage(spark, table, SF)
        assert out.columns == columns, name
        got = out.collect()
        assert sorted(r.doc_id for r in got) == sorted(want), name
        assert all(r.text == docs[r.doc_id] for r in got)
        table = spark.createDataFrame(got, table.schema)
    packed = corpus_pipeline.run(spark, SF).collect()
    size, load = {}, {}
    for r in packed:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        load[r.bin] = load.get(r.bin, 0) + r.length
    assert size == {i: len(t.split()) for i, t in kept.items()} and max(load.values()) <= packing.CAPACITY
    assert len(load) <= 1.1 * sum(load.values()) / packing.CAPACITY + 2


def test_decontamination_query_equals_brute_force(spark):
    """Every item against every text: the least edit distance to any passage, row by row of the whole matrix."""
    norm = lambda t: " ".join((t or "").lower().split())
    docs = [(i, norm(t)) for i, t in rows("documents").select("doc_id", "text").fetchall()]
    gap = "\0" * 100  # wider than any budget: no passage crosses it
    text = gap.join(t for _, t in docs)
    begin = np.cumsum([0] + [len(t) + len(gap) for _, t in docs])[:-1]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    want, step = set(), np.arange(len(codes) + 1, dtype=np.int32)
    for item, t in rows("benchmark").select("item_id", "text").fetchall():
        t = norm(t)
        budget = decontaminate.budget_of(t, decontaminate.ERROR_RATE)
        assert budget < len(gap)
        row = np.zeros(len(codes) + 1, np.int32)
        for i, c in enumerate(t, 1):
            now = np.empty_like(row)
            now[0] = i
            np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)), out=now[1:])
            row = np.minimum.accumulate(now - step) + step
        best = np.minimum.reduceat(row[1:], np.minimum(begin, len(codes) - 1))
        want |= {(i, item, int(d)) for (i, s), d in zip(docs, best) if s and d <= budget}
    got = queries.QUERIES["op10_decontamination"](spark, SF)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "distance").collect()} == want and got.count() == len(want) > 2


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, blanks, repeated rows, clashing columns and no rows at all, through all five stages in sequence."""
    texts = [(1, "same text here again"), (2, "same text here again"), (2, "same text here again"), (None, "same text here again"), (3, None), (None, None), (4, ""), (6, " \n "), (7, "x"), (8, "words " * 5000), (7, "another text of id seven")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, _key string, bin string"
    for name, given in (("some", [(i, t, "en", "s", None, "a", "b", "c") for i, t in texts]), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, 0), (None, None, 1)] if given else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "nothing like that"), (None, None), (2, "")] if given else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        table = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == schema.replace(" string", "").replace(" long", "").split(", ")
            table = spark.createDataFrame(out.collect(), out.schema)
        kept = {r.doc_id: len(r.text.split()) for r in table.collect()}
        got = corpus_pipeline.run(spark, folder).collect()
        size = {}
        for r in got:
            size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        assert set(size) == set(kept) and (kept or not given) and sum(size.values()) == sum(len(r.text.split()) for r in table.collect())

"""Every query of the index's own operators against its SQL, over whole tables."""

import hashlib
import os
import re
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from chunkloom import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(rows):
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        path = f"{SF}/{t}/*.parquet" if os.path.isdir(f"{SF}/{t}") else f"{SF}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", list(own.QUERIES))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF)
    if name not in own.SQL:
        assert got.count() > 0
        return
    columns = sorted(got.columns)
    want = sql.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_hash" in df.columns


def documents():
    path = f"{SF}/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')").fetchall()
    return {str(i): t for i, t in rows}


@pytest.mark.parametrize("name, snap", [("chunks_cdc_rabin", False), ("chunks_cdc_rabin_snap", True)])
def test_content_defined_queries_equal_brute_force(spark, name, snap):
    """Boundaries word by word, each rolling hash from scratch."""
    window, least, most, primary, backup, near = 48, 180, 640, 8, 6, 24
    want = set()
    for doc, text in documents().items():
        w = [unicodedata.normalize("NFC", x) for x in text.split()]
        symbols = [int.from_bytes(hashlib.blake2b(b"W" + x.encode(), digest_size=8, person=b"chunkloom-word-v1"[:16]).digest(), "big") for x in w]
        marks = [None] * (len(w) + 1)
        for p in range(window, len(w) + 1):
            v = 0
            for x in symbols[p - window : p]:
                v = (v * 0x100000001B3 + x) & (2**64 - 1)
            marks[p] = v
        ends = {i for i, x in enumerate(w, 1) if re.search(r"[.!?][\"')\]}]*$", x)}
        start, k = 0, 0
        while start < len(w):
            top = min(len(w), start + most)
            fit = [p for p in range(start + least, top + 1) if p <= len(w) and marks[p] is not None]
            first = next((p for p in fit if marks[p] % 2**primary == 0), None)
            last = next((p for p in reversed(fit) if marks[p] % 2**backup == 0), None)
            end = first or (top if top == len(w) else last or top)
            if snap and end < len(w):
                options = [p for p in range(end - near, end + near + 1) if start + least <= p <= start + most and p in ends and p <= len(w)]
                end = min(options, key=lambda p: (abs(p - end), -p), default=end)
            want.add((doc, k, start, end))
            start, k = end, k + 1
    got = {(r.document_id, r.position, r.start_word, r.end_word) for r in entry.queries()[name](spark, SF).collect()}
    assert got == want


def test_hash_embeddings_equal_brute_force(spark):
    want = {}
    for r in own._chunks(own._docs(spark, SF)).select("chunk_hash", "text").distinct().collect():
        tokens = re.findall(r"[^\W_]+", r.text)
        tokens = [t.casefold() for t in tokens]
        v = [0.0] * 64
        for f in tokens + [a + "\x1f" + b for a, b in zip(tokens, tokens[1:])]:
            d = hashlib.blake2b(f.encode(), digest_size=16, person=b"chunkloom-hash-v1"[:16]).digest()
            v[int.from_bytes(d[:8], "little") % 64] += 1 if d[8] % 2 else -1
        n = sum(x * x for x in v) ** 0.5
        want[r.chunk_hash] = [x / n if n else 0.0 for x in v]
    got = {r.chunk_hash: r.vector for r in entry.queries()["hash_embeddings"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)

"""Edits, churn and retrieval on our own corpora, with the bounds that the published figures set."""

import pytest
from chunkloom.operators import chunking as ch
from chunkloom.operators import fixtures, measure
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    return measure.own_corpora(spark).cache()


@pytest.fixture(scope="module")
def churn(docs):
    return [r.asDict() for r in measure.benchmark_churn(docs).collect()]


@pytest.fixture(scope="module")
def quality(spark, docs):
    return [r.asDict() for r in measure.benchmark_retrieval(docs, measure.own_questions(spark)).collect()]


def test_fixtures_are_sound():
    ids = [q.question_id for q in fixtures.QUESTIONS]
    assert len(fixtures.CORPORA) == 5 and sum(len(c.documents) for c in fixtures.CORPORA) == 10 and len(set(ids)) == 8
    corpora = {c.name: c for c in fixtures.CORPORA}
    for q in fixtures.QUESTIONS:
        assert all(any(e in t for t in corpora[q.corpus].documents.values()) for e in q.evidence)
    with pytest.raises(ValueError):
        fixtures.Corpus("x", "novel", {})


def test_the_grid_is_whole(churn):
    assert len(churn) == 5 * 5 * 9
    by = {}
    for r in churn:
        by.setdefault(r["strategy"], set()).add((r["corpus"], r["operation"]))
        assert r["reused_chunks"] + r["added_chunks"] == r["revised_chunks"] and r["reused_chunks"] + r["removed_chunks"] == r["original_chunks"]
        assert r["reembed_fraction"] == pytest.approx(r["added_chunks"] / r["revised_chunks"]) and r["estimated_cost"] == pytest.approx(r["tokens_to_embed"] * measure.PRICE / 1e6)
    assert {len(v) for v in by.values()} == {45} and by.keys() == measure.default_strategies().keys()


def test_unchanged_documents_count(churn, docs):
    chunker = measure.default_strategies()["fixed"]
    for c in fixtures.CORPORA:
        n = sum(len(ch.split_text(t, chunker)) for t in c.documents.values())
        assert {r["original_chunks"] for r in churn if r["strategy"] == "fixed" and r["corpus"] == c.name} == {n}


def test_content_defined_chunks_are_embedded_again_by_a_third_at_most(churn):
    for strategy in ("cdc-rabin", "cdc-rabin+snap"):
        mine = [r for r in churn if r["strategy"] == strategy]
        assert sum(r["added_chunks"] for r in mine) / sum(r["revised_chunks"] for r in mine) <= 0.35


def test_a_single_insertion(docs):
    one = docs.where("document_id = 'marsh.md'")
    got = {r.strategy: r.reembed_fraction for r in measure.benchmark_churn(one, operations=("insert-sentence",)).collect()}
    assert got["fixed"] >= 0.9 and got["cdc-rabin"] <= 0.25 and got["cdc-rabin+snap"] <= 0.25


def test_totals(spark, churn, docs):
    (row,) = [r for r in measure.totals(measure.benchmark_churn(docs, {"fixed": measure.default_strategies()["fixed"]})).collect()]
    mine = [r for r in churn if r["strategy"] == "fixed"]
    assert row.cases == 45 and row.added_chunks == sum(r["added_chunks"] for r in mine) and row.reembed_fraction == pytest.approx(row.added_chunks / row.revised_chunks)
    assert row.estimated_cost == pytest.approx(sum(r["estimated_cost"] for r in mine))


def test_retrieval_bounds(quality):
    mean = {}
    for r in quality:
        mean.setdefault((r["strategy"], r["scorer"]), []).append((r["recall"], r["ndcg"]))
    mean = {k: [sum(x) / len(v) for x in zip(*v)] for k, v in mean.items()}
    assert len(quality) == 8 * 5 * 2
    assert all(mean[s, x][0] == 1.0 for s in ("cdc-rabin", "cdc-rabin+snap") for x in measure.SCORERS)
    assert mean["cdc-rabin", "lexical"][1] >= 0.9 and mean["cdc-rabin", "hash-embedding"][1] >= 0.85
    assert all(mean[s, "lexical"][0] >= 0.8 and mean[s, "lexical"][1] >= 0.75 for s in measure.default_strategies())


def test_retrieval_is_checked(spark, docs):
    ask = lambda *rows: spark.createDataFrame(rows, "corpus string, question_id string, query string, evidence array<string>")
    one = {"fixed": measure.default_strategies()["fixed"]}
    for rows, said in (([("none", "q", "x", ["y"])], "unknown corpus"), ([("field-guide", "q7", "x", ["not there at all"])], "q7"), ([], "no question")):
        with pytest.raises(ValueError, match=said):
            measure.benchmark_retrieval(docs, ask(*rows), one)
    (row,) = measure.benchmark_retrieval(docs, ask(("field-guide", "q", "zzz yyy", ["the grey", "Grey  HERON"])), one, ("lexical",)).collect()
    assert row.relevant >= 1 and row.recall > 0  # no term in common: the first chunks in order


def test_edits_follow_their_rules():
    plain = "One here. Two here. Three\n\nFour word word.\n\nFive\n"
    assert measure.apply_edit(plain, "insert-section") == "One here. Two here. Three\n\n" + measure.SECTION + "\n\nFour word word.\n\nFive\n"
    assert measure.apply_edit(plain, "reorder-sections") == "Four word word.\n\nOne here. Two here. Three\n\nFive\n"
    assert measure.apply_edit("A b c. d e f", "delete-sentence") == "A b c."  # the last one has no full stop
    assert measure.apply_edit("a. b.\n", "delete-sentence") == "a.\n"
    assert measure.apply_edit("x\r\n\r\ny\r\n\r\nz", "delete-paragraph") == "x\n\nz"
    assert measure.apply_edit("az", "replace-same-length") == "bz"
    assert measure.apply_edit("ab cd", "global-replace", find="ab", replacement=r"\1") == r"\1 cd"
    assert measure.replaced_term("their their only_one only-two this each each only-two") == "only-two"
    assert measure._sections("# T\n\n## A\n\nx\n\n## B\n\ny")[0][0] == 5 and len(measure._sections("## A\n\nx")) == 2
    for text, op in (("", "append"), ("one", "delete-sentence"), ("one", "delete-paragraph"), ("one two", "global-replace"), ("12", "replace-same-length"), ("one", "reorder-sections")):
        with pytest.raises(ValueError):
            measure.apply_edit(text, op)
    with pytest.raises(ValueError):
        measure.apply_edit("ab", "global-replace", find="ab", replacement="ab")


def test_cases_take_the_longest_document_that_supports_all(spark):
    good, long = fixtures.CORPORA[0].documents["pump.md"], "nothing " * 2000
    docs = spark.createDataFrame([("c", "long", long), ("c", "b", good), ("c", "a", good), ("c", "short", good[:400])], "corpus string, document_id string, text string")
    for most in (1, 64):
        got = measure.edit_cases(docs, most=most).collect()
        assert {r.document_id for r in got} == {"a"} and {r.operation for r in got} == set(measure.EDITS) and all(r.original == good and r.revised == measure.apply_edit(good, r.operation) for r in got)
    with pytest.raises(ValueError, match="'c'"):
        measure.edit_cases(docs.where("document_id = 'long'"))


def test_chunks_of_other_splitters(spark):
    got = measure.snapshot(spark.createDataFrame([("a b c", None, None), ("d", "h", 7), ("d", "", -1)], "page_content string, chunk_hash string, token_count int")).collect()
    assert [r.token_count for r in got] == [3, 7, 1] and got[1].chunk_hash == "h" and len({r.chunk_hash for r in got}) == 3
    with pytest.raises(TypeError):
        measure.snapshot(spark.range(1))
    assert measure.snapshot(measure.own_corpora(spark)).where(F.length("chunk_hash") != 64).count() == 0

"""Retrieval quality on the command line."""

import json

from chunkloom import cli
from chunkloom.operators import measure
from chunkloom.plans import config as cf


def test_questions_without_evidence_and_both_scorers(spark, tmp_path, capsys, monkeypatch):
    first = dict(list(measure.default_strategies().items())[:1])
    monkeypatch.setattr(measure, "default_strategies", lambda: first)
    (tmp_path / "a.txt").write_text("The heron waits by the river at dawn.")
    path = str(tmp_path / "c.toml")
    cf.write_default(path)

    def measured(*evidence):
        (tmp_path / "q.json").write_text("\n".join(json.dumps({"question_id": f"q{i}", "query": "heron river", "evidence": [e]}) for i, e in enumerate(evidence)))
        code = cli.main(["measure-retrieval", "--config", path, "--json", "--questions", str(tmp_path / "q.json"), str(tmp_path / "a.txt")])
        return code, capsys.readouterr()

    code, said = measured("by the river")
    assert code == 0 and [r["scorer"] for r in json.loads(said.out.strip().splitlines()[-1])] == ["lexical", "hash-embedding"]
    assert cli.main(["measure-churn", "--config", path, "--json", str(tmp_path / "a.txt")]) != 0  # one sentence supports no deletion
    capsys.readouterr()
    code, said = measured("by the river", "not there")
    assert code != 0 and "q1" in said.err

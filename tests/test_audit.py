import json
import sys

import pytest

from rolegraph import audit, cli
from rolegraph.catalog import Catalog
from rolegraph.ingest.runners import kinds, register, runner
from rolegraph.lang.tree import ProgramError
from rolegraph.session import Session
from rolegraph.store.store import Store

from .graphs import relations

PROGRAMS = [
    "find player where age > 30 as p\nreturn p.name, p.age order by p.age desc limit 2",
    "find player as p\nfollow p seat place where country = PL as o\ngroup by o as g\ncount distinct g.p as n\nreturn o.name, n",
    "find player as p\nfollow p mentors junior upto any as q\nreturn p.name, q.name",
    'find orchestra where name contains "harm" or founded < 1960 as o\nreturn distinct o.country',
]


def test_comparison():
    assert audit.same_rows([[1, "a"], [2.0, None]], [[2, None], [1.0, "a"]])
    assert not audit.same_rows([[1], [1]], [[1]])
    assert audit.same_rows([[0.1 + 0.2]], [[0.3]]) and not audit.same_rows([[0.3001]], [[0.3]])
    assert audit.same_rows([[True, [1, 2]]], [[True, (1.0, 2)]]) and not audit.same_rows([[True]], [["true"]])
    assert not audit.same_rows([[1], [2]], [[2], [1]], ordered=True)
    assert audit.same_rows([[float("inf")], [0]], [[0.0], [float("inf")]])


def test_record_and_replay(spark, tmp_path):
    s, path = Session(relations(spark)), str(tmp_path / "frozen.jsonl")
    audit.record(s, PROGRAMS, path)
    r = audit.replay(s, path)
    assert r.right == len(PROGRAMS) and not r.wrong and not r.failed
    lines = [json.loads(x) for x in open(path, encoding="utf-8")]
    lines[0]["rows"].reverse()  # the first program orders its rows
    lines[1]["rows"].reverse()
    lines[2]["program"] = "find nobody as p\nreturn p"
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    r = audit.replay(s, path)
    assert r.right == 2 and r.wrong == [PROGRAMS[0]] and [p for p, _ in r.failed] == ["find nobody as p\nreturn p"]


def test_the_checker_refuses_every_broken_program(spark):
    refused, silent = audit.audit(PROGRAMS, relations(spark).catalog)
    assert silent == [] and refused >= 20


def test_runners(tmp_path):
    path = tmp_path / "answers.jsonl"
    path.write_text('"one"\n"two"\n', encoding="utf-8")
    ask = runner(f"recorded:{path}")
    assert [ask("x"), ask("y")] == ["one", "two"]
    with pytest.raises(ProgramError, match="no more"):
        ask("z")
    echo = runner(f"command:{sys.executable} -c \"import sys; print(sys.stdin.read().upper())\"")
    assert echo("hello") == "HELLO\n"
    with pytest.raises(ProgramError, match="ended with 3"):
        runner(f'command:{sys.executable} -c "import sys; sys.exit(3)"')("x")
    with pytest.raises(ProgramError, match="no answer"):
        runner("command:/no/such/program")("x")
    with pytest.raises(ProgramError, match="no runner"):
        runner("cloud:x")
    register("fixed", lambda text: lambda prompt: text)
    assert runner("fixed:same")("any") == "same" and "fixed" in kinds()


def test_books_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    book = "```schema\nderive class oats from entity with {size: int}\n```\n```aliases\nhaver = oats\n```\n```examples\nfind oats where size > 2 as o\nreturn o.name\n```"
    (tmp_path / "book.md").write_text(book, encoding="utf-8")
    (tmp_path / "answers.jsonl").write_text(json.dumps("no book") + "\n" + json.dumps(book) + "\n", encoding="utf-8")
    assert cli.main(["playbook", "--db", str(tmp_path / "a"), str(tmp_path / "book.md"), "--yes"]) == 0
    assert cli.main(["playbook", "--db", str(tmp_path / "b"), "--runner", f"recorded:{tmp_path}/answers.jsonl", "--yes"]) == 0
    assert capsys.readouterr().out.count("applied") == 2
    for name in ("a", "b"):
        with Store(spark, str(tmp_path / name), Catalog.standard()) as store:
            assert "oats" in store.catalog.classes
    assert cli.main(["playbook", "--db", str(tmp_path / "a"), "--yes"]) == 1


def test_duplicate_evidence_names_shared_properties(spark, tmp_path):
    c = Catalog.standard()
    c.add_class("flour", {"name": "str", "grams": "float", "kind": "str"})
    with Store(spark, str(tmp_path / "db"), c) as store:
        s = Session(store)
        s.execute('assert flour {name: "Spelt Flour", grams: 2, kind: "Fine"} as a')
        s.execute('assert flour {name: "Spelt Flouur", grams: 2.0, kind: "fine"} as b')
        assert s.rows("find dup_candidates as d\nreturn d.evidence") == [["names speltflouur and speltflour; both have grams 2.0, kind Fine"]]

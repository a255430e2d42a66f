import io
import json
import os
import zipfile

import pytest

from rolegraph import agent, cli
from rolegraph.catalog import Catalog
from rolegraph.functions.chunk import split, tokens
from rolegraph.functions.sniff import sniff
from rolegraph.ingest import playbook
from rolegraph.ingest.extract import extract
from rolegraph.ingest.normalize import UnsupportedKind, normalize
from rolegraph.ingest.stage import chunk_files, read_files, stage
from rolegraph.lang.tree import ProgramError
from rolegraph.session import Session
from rolegraph.sources.bulk import LoadProblem, load_edges, load_graph_json, load_nodes
from rolegraph.store.store import Store, StoreProblem
from rolegraph.store.writes import deprecate_class, sweep


def catalog():
    c = Catalog.standard()
    c.add_class("mill", {"name": "str", "built": "int", "open": "bool"})
    c.add_class("flour", {"name": "str", "grams": "float"})
    c.add_edge("grinds", {"site": "mill", "product": "flour"}, {"since": "int"})
    return c


@pytest.fixture()
def store(spark, tmp_path):
    with Store(spark, str(tmp_path / "db"), catalog()) as s:
        yield s


def test_assert_follow_retire_and_reopen(spark, store):
    s = Session(store)
    text = s.execute('assert mill {name: "North", built: 1990, open: true} as n\nassert flour {name: "Rye", grams: 2.5} source doc:a.pdf as r\nassert edge grinds(site: n, product: r)\nfind mill as m\nfollow m grinds product as f\nreturn m.name, f.name, f.grams, m.open')
    assert "North, Rye, 2.5, true" in text and "created #m-1" in text
    assert s.rows("find flour as f\nfollow f grinds site as m\nreturn m.id") == [["#m-1"]]
    s.execute('retire #f-1 reason "sold out"')
    assert s.rows("find mill as m\nfollow m grinds product as f\nreturn f.name") == []
    position = store.position()
    store.close()
    with Store(spark, store.path, catalog()) as again:
        assert again.position() == position
        assert Session(again).rows("find mill as m\nreturn m.name, m.built, m.open") == [["North", 1990, True]]
        again.snapshot()
        assert Session(again).rows("find mill as m\nreturn m.name") == [["North"]]
        assert len(again.manifest["segments"]) == 1


def test_one_writer_and_readers_follow(spark, store):
    with pytest.raises(StoreProblem, match="open for writing"):
        Store(spark, store.path)
    reader = Store(spark, store.path, catalog(), lock=False)
    assert reader.refresh() == 0
    Session(store).execute('assert mill {name: "A"} as a')
    assert Session(reader).rows("find mill as m\nreturn m.name") == []
    assert reader.refresh() == 1
    assert Session(reader).rows("find mill as m\nreturn m.name") == [["A"]]
    with pytest.raises(StoreProblem, match="reading only"):
        reader.commit([])


def test_a_crash_leaves_what_was_committed(spark, store):
    Session(store).execute('assert mill {name: "A"} as a')
    with open(os.path.join(store.path, "log-000000000099.jsonl"), "w") as f:
        f.write('{"op": "node", "ni')  # a segment that no manifest names
    store.close()
    with Store(spark, store.path, catalog()) as again:
        assert Session(again).rows("find mill as m\ncount m as n\nreturn n") == [[1]]
    for damage, says in (("{", "damaged"), ('{"format": 9}', "version"), (json.dumps({"format": 1, "pos": 1, "ops": {"odd": 1}, "segments": []}), "unknown kinds"), (json.dumps({"format": 1, "pos": 1, "ops": {}, "segments": ["gone"]}), "missing")):
        with open(os.path.join(store.path, "manifest.json"), "w") as f:
            f.write(damage)
        with pytest.raises(StoreProblem, match=says):
            Store(spark, store.path, lock=False)


def test_merge_candidates_distinct_and_health(store):
    s = Session(store)
    s.execute('assert flour {name: "Spelt Flour", grams: 1} as a\nassert mill {name: "M"} as m\nassert edge grinds(site: m, product: a)')
    assert "may repeat #f-1" in s.execute('assert flour {name: "spelt flouur", grams: 2} as b\nassert edge grinds(site: #m-1, product: b)')
    assert s.rows("find dup_candidates where class = flour as d\nreturn d.a, d.b") == [["#f-1", "#f-2"]]
    text = s.execute("merge #f-1, #f-2")
    assert "#f-1 survives; 1 edges moved" in text and "conflicts: grams, name" in text
    assert s.rows("find dup_candidates as d\nreturn d.a") == []
    assert s.rows("find flour as f\nreturn f.id, f.grams, f.health.loss") == [["#f-1", 2.0, 0.4]]
    assert "one node already" in s.run("merge #f-1, #f-2")
    assert "only nodes of one class" in s.run("merge #f-1, #m-1")
    s.execute('assert flour {name: "Spelt Flours"} as c\ndistinct #f-1, c reason "two kinds"\nflag c reason "x"')
    assert s.rows("find dup_candidates as d\nreturn d.a") == []
    assert sweep(store) == 0
    assert s.rows('find flour where id = "#f-3" as f\nreturn f.health.query') == [[pytest.approx(1 / 3)]]


def test_refine_compact_and_attachments(store):
    s = Session(store)
    os.makedirs(os.path.join(store.path, "attachments"))
    with open(os.path.join(store.path, "attachments", "prices.csv"), "w", encoding="utf-8-sig") as f:
        f.write("kind,weight\nOat,1.5\nCorn,2\n")
    s.execute('assert flour {name: attach:prices} as t')
    assert "no column x" in s.run('refine #f-1 into flour with {name: col "x"} as k')
    s.execute('refine #f-1 into flour with {name: col "kind", grams: col "weight"} as k')
    assert sorted(s.rows("find flour where state = atom as f\nreturn f.name, f.grams")) == [["Corn", 2.0], ["Oat", 1.5]]
    assert s.rows("find flour where state = composite as f\nreturn f.id") == [["#f-1"]]
    s.execute('find flour where grams > 0 as f\ncompact f as all {name: "Everything"}')
    assert sorted(r[0] for r in s.rows("find flour where state = composite as f\nreturn f.id")) == ["#f-1", "#f-4"]
    assert "no attachment" in s.run("assert flour {name: attach:../../etc/passwd} as z")


def test_derive_quota_deprecate(spark, store):
    s = Session(store)
    text = s.run('derive class rye from flour with {color: str} quota 1\nassert rye {name: "a", color: "red"} as a\nassert rye {name: "b"} as b')
    assert "quota of 1" in text and "2 writes before it are kept" in text
    assert s.rows("find flour as f\nreturn f.name, f.class") == [["a", "rye"]]
    s.execute("derive edge beside(left: mill, right: rye)")
    deprecate_class(store, "rye")
    assert "deprecated" in s.run('assert rye {name: "c"} as c')
    store.close()
    with Store(spark, store.path, catalog()) as again:
        assert again.catalog.classes["rye"].status == "deprecated" and "beside" in again.catalog.edges
    assert "nothing was executed" in s.run("assert rye {nme: 3} as c")


def test_bulk(spark, store, tmp_path):
    (tmp_path / "m.csv").write_text("name,built,open\nNorth,1990,yes\nSouth,,0\nTwin,1,t\nTwin,2,f\n", encoding="utf-8")
    (tmp_path / "f.jsonl").write_text('{"name": "Rye", "grams": "2.5"}\n{"name": "Oat"}\n')
    (tmp_path / "e.csv").write_text("m,f,since\nNORTH,rye,2001\n#m-2,Oat,\nTwin,Rye,3\nnone such,Rye,4\n")
    assert load_nodes(store, f"file://{tmp_path}/m.csv", "mill") == 4
    assert load_nodes(store, f"file://{tmp_path}/f.jsonl", "flour") == 2
    n, notes = load_edges(store, f"file://{tmp_path}/e.csv", "grinds", {"site": "m", "product": "f"})
    assert n == 2 and any("2 nodes" in x for x in notes) and any("no such node" in x for x in notes)
    s = Session(store)
    assert sorted(s.rows("find mill as m\nfollow m grinds product where via.since = none or via.since > 2000 as f\nreturn m.name, f.name, m.open")) == [["North", "Rye", True], ["South", "Oat", False]]
    (tmp_path / "bad.csv").write_text("name,built\nX,12a\n")
    (tmp_path / "odd.csv").write_text("name,height\nX,1\n")
    before = store.position()
    for file, says in (("bad.csv", "no int"), ("odd.csv", "no property height")):
        with pytest.raises(LoadProblem, match=says):
            load_nodes(store, f"file://{tmp_path}/{file}", "mill")
    assert store.position() == before
    assert s.execute('assert mill {name: "East"} as e').endswith("#m-5")


def test_graph_json(spark, tmp_path):
    doc = {
        "entities": [{"eid": "a", "label": "Person", "name": "Ada", "properties": {"age": 36, "zone": None}}, {"eid": "b", "label": "Person", "name": "Bo", "properties": {"age": 1, "zone": None}}, {"eid": "c", "label": "City", "name": "Oslo", "properties": {"age": None, "zone": "N"}}],
        "relations": [{"label": "knows", "subj_id": "a", "obj_id": "b", "properties": {"since": 3}}, {"label": "at", "subj_id": "a", "obj_id": "c", "properties": {"since": None}}, {"label": "at", "subj_id": "a", "obj_id": "b", "properties": {"since": 1}}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    s = Session(load_graph_json(spark, f"file://{tmp_path}/g.json"))
    assert s.rows("find person as p\nfollow p knows obj where via.since > 2 as q\nreturn p.name, q.name") == [["Ada", "Bo"]]
    assert s.rows("find person as p\nfollow p at_person_city city as c\nreturn c.name, c.zone") == [["Oslo", "N"]]


@pytest.mark.parametrize(
    "data,name,kind",
    [(b"\x89PNG\r\n\x1a\nxx", "", "png"), (b"RIFF1234WEBP", "", "webp"), (b"%PDF-1.4", "", "pdf"), (b'{"a": 1}', "", "json"), (b"42", "", "json"), (b'{"a": 1}\n{"a": 2}\n', "", "jsonl"), (b"# Title\n\ntext", "", "markdown"), (b"a,b\n1,2\n3,4\n", "", "csv"), (b"plain words", "x.txt", "text"), (b"", "", "text"), (b"\xff\xfe\x00", "", "binary"), (b"a\x00b", "", "binary"), (b"only", "x.csv", "csv"), (b"PK\x03\x04zz", "", "binary")],
)
def test_sniff(data, name, kind):
    assert sniff(data, name) == kind


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_normalize():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    docx = office({"word/document.xml": f"<w:document {w}><w:body>{p('Top', 'Heading2')}{p('Body')}<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('a')}{cell('1')}</w:tr></w:tbl></w:body></w:document>"})
    env = normalize(docx, "x.docx")
    assert env.body == "## Top\n\nBody" and env.tables[0].rows == [{"k": "a", "v": "1"}]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = office({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>k</t></si><si><t>z</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>'})
    env = normalize(xlsx, "x.xlsx")
    assert env.tables[0].name == "One" and env.tables[0].rows == [{"k": "5", "column2": "", "z": ""}]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda *t: f"<s {a}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</s>"
    env = normalize(office({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": slide("T1", "b"), "ppt/slides/slide2.xml": slide("T2"), "ppt/notesSlides/notesSlide2.xml": slide("say")}), "x.pptx")
    assert env.body == "# T1\n\nb\n\n# T2\n\nNotes: say" and env.page_at(env.body.index("say")) == 2
    assert normalize(b'[{"a": 1}, {"b": [2]}]', "t.json").tables[0].rows == [{"a": "1", "b": ""}, {"a": "", "b": "[2]"}]
    assert normalize(b'{"a": 1}', "t.json").body.startswith("```json")
    with pytest.raises(UnsupportedKind):
        normalize(b"\x00\x01", "x.bin")


def test_chunks():
    text = "# A\n\n" + "word " * 300 + "\n\n" + "more " * 300 + "\n\n# B\n\nshort\n\n" + "x" * 6000
    parts = split(text)
    assert all(tokens(t) <= 600 for t, _ in parts)
    assert parts[0][0].startswith("# A") and any(t.startswith("# B\n\nshort") for t, _ in parts)
    assert split("") == [] and split("  \n ") == []
    assert "".join(t for t, _ in split("y" * 5000)) == "y" * 5000


@pytest.mark.parametrize("n", [2400, 2401, 2403, 2404, 4800, 4803, 12001])
def test_a_long_paragraph_is_cut_at_every_2400_signs(n):
    assert [(at, len(t)) for t, at in split("z" * n)] == [(at, min(2400, n - at)) for at in range(0, n, 2400)]
    # paragraphs that fit together by tokens stay together
    assert [(at, len(t)) for t, at in split("a" * 1200 + "\n\n" + "b" * 1201)] == [(0, 2403)]


def test_stage_extract_and_feed(spark, store, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Mills\n\nNorth grinds rye.")
    (folder / "b.md").write_text("# Mills\n\nNorth grinds rye.")
    (folder / "t.csv").write_text("k,v\na,1\nb,2\n")
    assert chunk_files(read_files(spark, f"file://{folder}")).where("error is null and text is not null").count() == 1
    doc, _ = stage(store, (folder / "a.md").read_bytes(), "a.md")
    again, notes = stage(store, (folder / "b.md").read_bytes(), "b.md")
    assert again == doc and "already" in notes[0]
    stage(store, (folder / "t.csv").read_bytes(), "t.csv")
    s = Session(store)
    assert s.rows('find document where title = "a.md" as d\nfollow d part_of piece as c\nreturn c.class') == [["chunk"]]
    replies = iter(["not a program", '```\nassert mill {name: "North"} as m\n```'])
    got = extract(s, doc, lambda prompt: next(replies))
    assert got.done == 1 and not got.failed
    got = extract(s, doc, lambda prompt: "nonsense")
    assert len(got.failed) == 1
    assert extract(s, doc, lambda prompt: "", budget=1).stopped
    from rolegraph.streaming.feed import counters, follow_changes

    seen = []
    q = follow_changes(store, lambda batch, n: seen.extend(r.op for r in batch.collect()), f"file://{tmp_path}/ck")
    q.processAllAvailable()
    first = len(seen)
    s.execute('assert mill {name: "Late"} as m')
    q.processAllAvailable()
    q.stop()
    assert first > 5 and len(seen) == first + 1
    q = counters(store).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counted where op = 'node' and cls = 'mill'").first()[0] == 2


def test_answer_and_book(store):
    s = Session(store)
    s.execute('assert mill {name: "North"} as m')
    replies = iter(["find mil as m\nreturn m", "```\nfind mill as m\nreturn m.name\n```"])
    got = agent.answer(s, "which mills are there?", lambda p: next(replies))
    assert got.rows == [["North"]] and got.turns == 2
    assert agent.answer(s, "?", lambda p: "bad", turns=2).error
    book = "```schema\nderive class oats from flour with {size: int}\n```\n```aliases\nhaver = oats\n```\n```examples\nfind oats where size > 2 as o\nreturn o.name\n```"
    tries = iter([book.replace("size > 2", "sise > 2"), book])
    plan = playbook.compile_book(s, lambda error: next(tries), lambda p: True)
    assert [d.name for d in plan.derive] == ["oats"] and "oats" in store.catalog.classes
    assert playbook.compile_book(s, lambda error: book, lambda p: False) is None
    with pytest.raises(ProgramError, match="lacks"):
        playbook.plan(s, "nothing")
    empty = book.replace("derive class oats from flour with {size: int}", "derive class bran from flour with {size: int}").replace("oats", "bran")
    playbook.compile_book(s, lambda error: empty, lambda p: True)
    assert store.catalog.classes["oats"].status == "deprecated"


def test_command_line(spark, tmp_path, capsys):
    db = str(tmp_path / "db")
    assert cli.main(["run", "--db", db, 'assert entity {name: "x"} as e\nfind entity as e\nreturn e.name']) == 0
    assert "created #e-1" in capsys.readouterr().out
    assert cli.main(["run", "--db", db, "find nothing as e\nreturn e"]) == 1
    assert "nothing was executed" in capsys.readouterr().err
    (tmp_path / "e.csv").write_text("name\ny\nz\n")
    assert cli.main(["load-nodes", "--db", db, f"file://{tmp_path}/e.csv", "entity"]) == 0
    assert cli.main(["stats", "--db", db]) == 0
    assert "entity: 3 nodes made" in capsys.readouterr().out
    assert cli.main(["canonical", "find  entity   as e"]) == 0
    assert capsys.readouterr().out == "find entity as e\n"


def test_traffic_is_counted_where_it_is_asked_for(spark, tmp_path):
    c = catalog()
    program = 'find mill as m\nfollow m grinds product as f or none\nreturn m.name, f.name'
    with Store(spark, str(tmp_path / "db"), c, track=True) as store:
        s = Session(store)
        s.execute('assert mill {name: "A"} as a\nassert mill {name: "B"} as b\nassert flour {name: "R"} as r\nassert edge grinds(site: a, product: r)')
        assert s.rows("find mill as m\nreturn m.name, m.query_traffic") == [["A", 0], ["B", 0]]
        position = store.position()
        s.rows(program)
        s.execute(program)
        assert store.position() == position  # reads leave no record
        assert sorted(s.rows("find nodes as n\nreturn n.name, n.query_traffic")) == [["A", 2], ["B", 0], ["R", 2]]
        assert s.rows('find mill where name = "A" as m\nfollow m grinds product as f\nfollow f grinds site as x or none\nreturn m.name') == [["A"]]
        assert s.rows('find mill where name = "A" as m\nreturn m.query_traffic') == [[4]]  # left by one follow, reached by the other
    with Store(spark, str(tmp_path / "db"), c) as plain:
        s = Session(plain)
        s.rows(program)
        assert s.rows('find mill where name = "A" as m\nreturn m.query_traffic, m.health.structure') == [[4, pytest.approx(0.01)]]


def test_walks_through_blobs_weigh_on_structure(spark, tmp_path):
    c = catalog()
    with Store(spark, str(tmp_path / "db"), c, track=True) as store:
        s = Session(store)
        os.makedirs(os.path.join(store.path, "attachments"))
        with open(os.path.join(store.path, "attachments", "t.csv"), "w") as f:
            f.write("kind\nOat\n")
        s.execute('assert mill {name: "A"} as a\nassert flour {name: attach:t} as r\nassert edge grinds(site: a, product: r)')
        for _ in range(2):
            s.rows("find mill as m\nfollow m grinds product as f\nreturn f.id")
        assert s.rows("find flour as f\nreturn f.health.structure, f.query_traffic") == [[pytest.approx(0.04), 2]]

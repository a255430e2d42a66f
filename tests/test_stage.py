import json

from rolegraph.catalog import Catalog
from rolegraph.ingest.stage import stage, stage_files
from rolegraph.session import Session
from rolegraph.store.store import Store

FILES = [
    ("b.txt", "First paragraph.\n\nSecond one. " + "word " * 900), ("a.txt", "same text"), ("z.txt", "same text"), ("empty.txt", "   "), ("t.csv", "kind,grams\nrye,2\noat,3\n"),
    ("x.bin", b"\x00\x01\x02\xff\xfe\x00\x00"), ("page.html", "<html><body><h1>Head</h1><p>Some text here.</p></body></html>"), ("n.json", json.dumps([{"k": 1}, {"k": 2}])),
]


def frame(spark, files=FILES):
    return spark.createDataFrame([(n, c if isinstance(c, bytes) else c.encode()) for n, c in files], "file string, content binary").repartition(3)


def view(store):
    """Documents by title with their pieces, without ids and order of numbers."""
    s = Session(store)
    docs = sorted(map(tuple, s.rows("find document as d\nreturn d.title, d.mime, d.pages, d.sha256, d.state")), key=str)
    pieces = sorted((tuple(map(str, r)) for r in s.rows("find chunk as c\nfollow c part_of whole as d\nreturn d.title, c.ord, c.page, c.text, c.state")))
    return docs, pieces


def test_staging_by_tasks_equals_one_by_one(spark, tmp_path):
    with Store(spark, str(tmp_path / "a"), Catalog.standard()) as one, Store(spark, str(tmp_path / "b"), Catalog.standard()) as many:
        refused = {}
        for name, content in sorted(FILES):
            try:
                stage(one, content if isinstance(content, bytes) else content.encode(), name)
            except ValueError as e:
                refused[name] = str(e)
        n, errors = stage_files(many, frame(spark))
        assert {r.file: r.error for r in errors.collect()} == refused
        assert view(one) == view(many) and n == len(view(one)[0])
        ids = [r.nid for r in many.records().where("op = 'node'").collect()]
        positions = [r.pos for r in many.records().collect()]
        assert len(set(ids)) == len(ids) and sorted(positions) == list(range(1, many.position() + 1))
        # again: nothing new; then one new file
        assert stage_files(many, frame(spark))[0] == 0
        assert stage_files(many, frame(spark, [*FILES, ("new.txt", "new text")]))[0] == 1
        many.snapshot()
        assert len(view(many)[0]) == n + 1
        assert stage_files(many, frame(spark).limit(0))[0] == 0
        # a table's rows are in the log, so it can be refined
        blob = Session(many).rows('find chunk where state = blob as c\nreturn c.id')
        assert blob and "refine" in Session(many).execute(f'derive class grain from entity with {{grams: int}}\nrefine {blob[0][0]} into grain with {{name: col "kind", grams: col "grams"}} as g')
        assert sorted(Session(many).rows("find grain as g\nreturn g.name, g.grams")) == [["oat", 3], ["rye", 2]]


def test_prose_with_commas_in_each_line_is_staged_as_text(spark, tmp_path):
    prose = "Over the hill, under the bridge.\nAlong the river, past the mill."
    with Store(spark, str(tmp_path / "a"), Catalog.standard()) as store:
        assert stage_files(store, frame(spark, [("p.txt", prose), ("t.csv", "kind,grams\nrye,2\noat,3\n")]))[0] == 2
        assert Session(store).rows('find chunk where state = atom as c\nfollow c part_of whole as d\nreturn d.title, d.mime, c.ord, c.text') == [["p.txt", "text", 0, prose]]

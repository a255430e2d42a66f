import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from rolegraph.llm import _spark as S

from .conftest import prose
from .test_jaccard import brute, family

pytest.importorskip("public_tokenizers")


def test_every_stage_takes_effect(spark, tmp_path):
    texts = [prose(i, 60) for i in range(80)]
    toxic = {k for k in range(80) if k % 4 == 0}
    texts = [t + (" vilegrob nastygrob" if k in toxic else "") for k, t in enumerate(texts)]
    copies = [texts[1], texts[1], texts[3]]
    near = family(77, 6, 120, 1)
    item = prose(999, 30)
    leaks = [prose(901, 40) + " " + item + " " + prose(902, 40)]
    every = texts + copies + near + leaks
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(every)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, frame, d)
        assert out.columns == frame.columns
        out.write.parquet(f"{d}/out-{name}")
        frame = spark.read.parquet(f"{d}/out-{name}")
        seen.append({r.doc_id for r in frame.collect()})
    want = {i for i in range(len(every))} - toxic
    assert seen[0] == want
    want = {max(k for k in want if every[k] == every[i]) for i in want}
    assert seen[1] == want
    want = {k for k, _, c in brute([(k, every[k]) for k in sorted(want)]) if k == c}
    assert seen[2] == want
    want -= {len(every) - 1}
    assert seen[3] == want
    before = set(S._tables)
    pieces = C.run(spark, d)
    assert {p.rpartition("/")[2].rpartition("-")[0] for p in set(S._tables) - before} == {f"pipeline-{n}" for n, _ in C.STAGES[:-1]}  # the others are deleted
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == want
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0


def folder(spark, d, labels=((1, 0), (2, 1)), items=()):
    spark.createDataFrame([(k, 0, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def key(r):
    return (r.doc_id is not None, r.doc_id or 0, r.text or "")


def test_odd_rows_pass_every_stage(spark, docs, no_docs, tmp_path):
    """Null and empty texts, null and repeated keys, repeated rows, ties, a very long text, columns that clash."""
    d = folder(spark, tmp_path, [(k, int(k in (3, 5))) for k in range(40)], [(1, prose(110, 80)), (2, None), (3, "")])
    rows = sorted(docs.collect(), key=key)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        got = sorted(out.collect(), key=key)
        assert all(r in rows for r in got), name
        assert len([r for r in got if r.doc_id == 110]) == 1, name  # the very long text
        empty = stage(spark, no_docs, d)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert C.packing(spark, no_docs, d).count() == 0
    pieces = C.packing(spark, docs, d).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}
    # equal texts: the largest doc_id; null text is empty text
    kept = C.exact_dedup(spark, docs, d).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (100, 101, 111)) == [111, 111] and [r.doc_id for r in kept if not r.text] == [105]


def test_rows_that_share_a_key_have_a_fate_each(spark, tmp_path):
    bad = "vilegrob nastygrob "
    train = [(i, prose(i, 40) + (bad if i % 4 == 0 else "")) for i in range(60)]
    item, twin = prose(999, 30), prose(55, 90)
    rows = train + [(None, prose(70, 40)), (None, bad * 3), (None, item), (None, twin), (500, twin + " more"), (600, prose(71, 40)), (600, item), (600, prose(72, 50)), (700, prose(72, 50)), (600, "unlike " + prose(73, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    d = folder(spark, tmp_path, [(i, int(i % 4 == 0)) for i in range(60)], [(1, item)])
    left = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, docs, d).collect()), key=str)
    assert left(C.toxicity) == sorted(((k, t) for k, t in rows if "vilegrob" not in t), key=str)
    assert left(C.decontaminate) == sorted(((k, t) for k, t in rows if item not in t), key=str)
    assert left(C.exact_dedup) == sorted(((k, t) for k, t in rows if (k, t) not in ((600, prose(72, 50)), (None, item))), key=str)
    # near copies: 500 against null, and the equal texts of 600 and 700
    assert left(C.near_dedup) == sorted(((k, t) for k, t in rows if (k, t) not in ((None, twin), (700, prose(72, 50)), (None, item))), key=str)


def test_near_dedup_moves_no_sets_of_what_meets_by_chance(spark, tmp_path, monkeypatch):
    from rolegraph.llm import jaccard as M

    made, was = {}, M.written

    def counting(df, name):
        out = was(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(M, "written", counting)
    texts = []
    for g in range(12):  # seven texts, each two of which share a passage
        shared = {(i, j): [f"g{g}p{i}{j}w{k}" for k in range(40)] for i in range(7) for j in range(i)}
        texts += [" ".join(w for pair, words in shared.items() if i in pair for w in words) for i in range(7)]
    texts += family(8, 6, 80, 1)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in dict(C.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert got == {k for k, _, c in brute(list(enumerate(texts))) if k == c}
    assert made["jaccard-cells"] > 30 and made["jaccard-sets"] <= 12, made


@pytest.mark.parametrize("full", [False, True])
def test_near_dedup_moves_no_texts_past_the_broadcast_limit(spark, tmp_path, monkeypatch, full):
    from rolegraph.llm import jaccard as M

    plans, was = {}, M.written

    def noting(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return was(df, name)

    monkeypatch.setattr(M, "written", noting)
    monkeypatch.setattr(M, "small_enough", lambda *_: False)
    if full:  # a filter that lets every text in
        monkeypatch.setattr(M, "bloom", lambda _: M.np.full(1 << 12, 255, M.np.uint8))
    texts = [t for f in range(6) for t in family(f, 9, 60 + 9 * f, 2)] + [prose(900 + i, 50) for i in range(9)] + ["", None]
    texts += texts[3:9]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0] + " more"), (None, prose(990, 40))], "doc_id long, text string").repartition(3)
    rows = sorted(map(tuple, docs.collect()), key=str)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        kept = sorted(map(tuple, dict(C.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.set(limit, before)
    assert [k for k, _ in kept if k is not None] == [k for k, _, c in brute(rows) if k == c and k is not None]
    assert [t for k, t in kept if k is None] == [prose(990, 40)]
    for name in ("jaccard-signatures", "jaccard-sets"):
        assert plans[name] and not any("Join" in p for p in plans[name]), name
    assert not any("class#" in p for p in plans["jaccard-across"] + plans["jaccard-matrix"])  # entries moved by class before, once

import re

from rolegraph.llm import decontaminate as M

from .conftest import prose


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            for lies in range(-len(v) + 1, len(w)) if v else ():
                same = sum(w[lies + k] == v[k] for k in range(len(v)) if 0 <= lies + k < len(w))
                if same >= len(v) * M.SIMILARITY - 1e-9 and (len(v) >= 5 or same == len(v)):
                    out[d, i] = max(out.get((d, i), 0), same)
    return out


def test_against_brute_force(spark):
    items = [(i, prose(500 + i, 12 + i)) for i in range(25)] + [(90, None), (91, ""), (92, "tiny one"), (93, prose(500, 12))]
    docs = []
    for i in range(60):
        w = prose(i, 50 + 20 * i).split()
        t = prose(500 + i % 25, 12 + i % 25).split()
        for k in range(i % 7):  # i % 7 words replaced, evenly spread
            t[(k * len(t)) // 7] = f"other{k}"
        docs.append((i, " ".join(w[:20] + t + w[20:])))
    docs += [(100, None), (101, ""), (102, prose(510, 22)), (103, " ".join(prose(512, 24).split()[3:])), (104, "a tiny one b"), (None, prose(505, 17)), (105, prose(900, 20000) + " " + prose(503, 15).upper())]
    docs += [docs[0]]
    got = M.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", __import__("pyspark").sql.functions.lit(1)).repartition(4), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", __import__("pyspark").sql.functions.lit(1)))
    assert {(r.doc_id, r.item_id): r.matched for r in got.collect()} == brute(docs, items)


def test_filter_and_empty(spark, docs, no_docs):
    items = spark.createDataFrame([(1, prose(110, 80))], "item_id long, text string")
    left = M.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted({r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()}, key=str) == [10]
    assert M.contaminated(no_docs, items).count() == 0
    assert M.drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


def test_letters_of_every_script_are_folded(spark):
    item = "la canción número ñandú écoute où été straße übung grün река улица"
    docs = spark.createDataFrame([(1, "x y " + item.upper().replace("STRASSE", "STRAßE") + " z"), (2, "nothing of it")], "doc_id long, text string")
    got = M.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.item_words) for r in got] == [(1, 5, 12, 12)]


def fewest_replaced(n, masks):
    """The least number of replaced words in an item of n that keeps every mask from being hit, over all their places."""
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    span = max(map(len, masks))
    best = {(): 0}
    for _ in range(n):
        after = {}
        for last, cost in best.items():
            for w in (0, 1):
                now = (last + (w,))[-span:]
                if any(len(now) >= len(m) and all(now[len(now) - len(m) + i] for i in o) for m, o in zip(masks, ones)):
                    continue
                after[now] = min(after.get(now, n), cost + 1 - w)
        best = after
    return min(best.values())


def test_masks_hit_every_item():
    for n in range(5, 200):
        may = n - -(-n * 4 // 5)
        masks = [m for m, _, least, most in M.laid_masks([n]) if least <= n <= most]
        assert fewest_replaced(n, masks) > may, n
    assert [m for m, *_ in M.laid_masks([3, 3000])] == [*M.MASKS, "111"]


def test_short_items_against_brute_force(spark):
    r = __import__("random").Random(3)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 13)]
    docs = []
    for n, text in items:
        for k in range(8):
            w = text.split()
            for x in r.sample(range(n), min(n, k % 4)):
                w[x] = f"r{x}"
            docs.append((len(docs), " ".join(prose(k, 6).split()[: k % 3] + w + ["tail"] * (k % 2))))
    got = M.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.matched for x in got.collect()} == brute(docs, items)


def test_many_places_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(M, "LAYS", 5)
    items = [(i, prose(600 + i, 13)) for i in range(12)]
    docs = [(1, " ".join(t for _, t in items) + " " + prose(601, 13)), (2, prose(4, 30)), (None, items[3][1] + " " + items[4][1])]
    got = M.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.matched for x in got.collect()} == brute(docs, items)

import random
import re

import pytest

from rolegraph.llm import jaccard as M

from .conftest import prose


def brute(rows):
    sets = []
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and 100 * x >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        known = [x for x in least[find(i)] if x is not None]
        out.append((k, len(sets[i]), k if len(least[find(i)]) == 1 or not known else min(known)))
    return sorted(out, key=str)


def family(seed, count, words, edits):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"edit{r.randrange(50)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, docs):
    assert sorted(map(tuple, M.jaccard_components(docs).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_families_chains_and_shared_passages(spark, seed):
    r = random.Random(seed)
    texts = [t for f in range(12) for t in family(100 * seed + f, 14, 30 + 12 * f, 3)] + family(seed + 70, 120, 60, 4)
    passage = prose(seed + 999, 40)
    texts += [f"{prose(seed * 7000 + i, r.randrange(3, 14))} {passage}" for i in range(60)]
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[i * 6 : i * 6 + 100]) for i in range(40)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = M.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_filter_and_empty(docs, no_docs):
    kept = M.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {k for k, _, c in brute([(r.doc_id, r.text) for r in docs.collect()]) if k == c}
    assert {r.doc_id for r in kept.collect()} == want
    assert M.jaccard_components(no_docs).count() == 0


def test_sets_that_share_a_name_stay_apart(spark):
    texts = [t for f in range(8) for t in family(40 + f, 6, 30 + 5 * f, 2)] + [prose(500 + i, 9) for i in range(40)]
    rows = list(enumerate(texts + texts[:20]))
    got = M.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), name_bits=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_parts_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_TOKENS", 600)  # large groups are cut
    r = random.Random(9)
    texts = family(3, 150, 60, 3) + family(4, 60, 200, 4) + [t for f in range(6) for t in family(50 + f, 10, 40, 2)]
    base = prose(77, 60).split()
    for i in range(80):  # one word changed: linked with neighbours only
        w = list(base)
        w[r.randrange(60)] = f"other{i}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = M.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_part_and_its_queries():
    rng = random.Random(4)
    sets, ids = [], []
    for f in range(5):
        base = rng.sample(range(10_000 * f, 10_000 * f + 500), 60)
        for _ in range(40):
            s = set(base)
            for x in rng.sample(base, rng.randrange(9)):
                s.discard(x)
                s.add(rng.randrange(10_000 * f, 10_000 * f + 500))
            sets.append(M.np.array(sorted(s), dtype=M.np.uint64))
            ids.append(len(ids) * 7)
    order = list(range(len(ids)))
    rng.shuffle(order)
    held, asks = sorted(order[:120]), sorted(order[120:])
    for own in (True, False):
        top = {i: i for i in ids}

        def find(i):
            while top[i] != i:
                i = top[i]
            return i

        for a in held if own else []:
            for b in held:
                if M.common(sets[a], sets[b]) * 9 >= (len(sets[a]) + len(sets[b])) * 4:
                    top[find(ids[a])] = find(ids[b])
        for a in asks:
            for b in held:
                if M.common(sets[a], sets[b]) * 9 >= (len(sets[a]) + len(sets[b])) * 4:
                    top[find(ids[a])] = find(ids[b])
        links = M.spanning_links(M.np.array([ids[i] for i in held]), [sets[i] for i in held], M.np.array([ids[i] for i in asks]), [sets[i] for i in asks], own)
        own_top = {i: i for i in ids}

        def got(i):
            while own_top[i] != i:
                i = own_top[i]
            return i

        for a, b in links:
            assert got(a) != got(b)  # no link more than is needed
            own_top[got(a)] = got(b)
        assert {(i, j): find(i) == find(j) for i in ids for j in ids} == {(i, j): got(i) == got(j) for i in ids for j in ids}


def test_a_family_grows_in_proportion(spark, monkeypatch):
    made = {}
    was = M.written

    def counting(df, name):
        out = was(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(M, "written", counting)
    monkeypatch.setattr(M, "PART_TOKENS", 8_000)
    base, seen = prose(5, 60).split(), {}
    for n in (250, 1000):
        r = random.Random(n)
        texts = []
        for i in range(n):
            w = list(base)
            w[r.randrange(60)] = f"w{i}"
            texts.append(" ".join(w))
        made.clear()
        M.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).count()
        seen[n] = {k: v for k in ("jaccard-links", "jaccard-asks", "jaccard-entries") for v in [sum(made[k][:2])]}
    for n, v in seen.items():  # the pairs that are linked grow with the square
        assert v["jaccard-links"] <= 3 * n and v["jaccard-asks"] <= 2 * n and v["jaccard-entries"] <= 8 * n, seen


def linked(a, b):
    return M.common(a, b) * 9 >= (len(a) + len(b)) * 4


@pytest.mark.parametrize("pairs", [8 << 20, 10])
@pytest.mark.parametrize("most", [15, 1])
def test_signatures_never_part_what_is_linked(monkeypatch, pairs, most):
    monkeypatch.setattr(M, "SIFT_PAIRS", pairs)
    monkeypatch.setattr(M, "MOST", most)  # nearly every count is cut at 1, so sets go by what is not counted
    rng = random.Random(7)
    sets, label = [], []
    for f, n in enumerate([1, 2, 3, 9, 60, 118, 127, 128, 129, 130, 140, 500, 520, 2000]):
        base = [rng.getrandbits(64) for _ in range(n)]
        for _ in range(5):
            s = set(base) - set(rng.sample(base, rng.randrange(n // 7 + 1))) | {rng.getrandbits(64) for _ in range(rng.randrange(n // 7 + 1))}
            sets.append(M.np.array(sorted(s), dtype=M.np.uint64))
            label.append(f * 100 + rng.randrange(4))
    alone = len(sets)  # from here on no set shares anything with another
    sets += [M.np.array(sorted(rng.getrandbits(64) for _ in range(rng.randrange(300, 600))), dtype=M.np.uint64) for _ in range(40)]
    label += range(10_000, 10_040)
    begin = M.np.concatenate(([0], M.np.cumsum([len(s) for s in sets])))
    packed = M.binary_list(*M.signatures(M.np.concatenate(sets), begin)).to_pylist()
    size, label = M.np.diff(begin), M.np.array(label)
    for own in (True, False):
        member = M.np.array([rng.random() < 0.6 for _ in sets])
        keep = M.sift(size, packed, label, member, own)
        need = {i for i in range(len(sets)) for j in range(len(sets)) if label[i] != label[j] and linked(sets[i], sets[j]) and (member[i] != member[j] or own and member[i])}
        assert need and need <= set(M.np.flatnonzero(keep))
        if most == 15 and pairs > 10:
            assert not keep[alone:].any()


def test_sets_move_only_where_signatures_agree(spark, monkeypatch):
    made = {}
    was = M.written

    def counting(df, name):
        out = was(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(M, "written", counting)
    rows = []
    for g in range(20):  # seven texts, each two of which share a passage: their prefixes meet, their sets are far apart
        shared = {(i, j): [f"g{g}p{i}{j}w{k}" for k in range(40)] for i in range(7) for j in range(i)}
        rows += [" ".join(w for pair, words in shared.items() if i in pair for w in words) for i in range(7)]
    rows = list(enumerate(rows + family(8, 6, 80, 1)))
    got = M.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert made["jaccard-cells"] > 60 and made["jaccard-sets"] <= 12, made

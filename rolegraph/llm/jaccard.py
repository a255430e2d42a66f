"""Documents linked by Jaccard similarity of word shingles, through a token-group matrix.

Sets.  A document's set is its distinct runs of five lower-cased words (all its words, if fewer).
Equal sets are one class, and from there on a class takes the place of its documents.  A class is
named by a 64-bit hash of its set; a second hash tells whether two sets share a name, and then stands
in for it.

Order.  Shingles are ordered by how many documents hold them, as a count sketch of fixed size over
all documents estimates it, and then by hash: any order that all documents share is right, and this
one puts what many documents hold last.  Two sets that reach the similarity meet in the first
n - ceil(t n) + 1 shingles of each (their prefix), at places that leave room for the overlap.  Classes
that share no shingle of a prefix with another class are linked with nothing and leave here.

Groups.  The others are partitioned: each class joins the one of its KEYS minimum hashes that most
classes share, so a family of near copies ends in a few groups however large it is.  A group is cut
into parts of PART_TOKENS shingles.

Matrix.  A row is a shingle of a prefix, its columns are the parts that hold it, with the sizes and
places found there.  Two parts whose columns meet in a row with room for the overlap are a cell.

Sifting.  Parts of a large corpus meet by chance far more often than their members are linked, and
sets are as large as the texts.  So what meets is first held against each other by signatures, counts
of a set's shingles in some buckets (a quarter of a byte a shingle at most): the lesser counts add up
to a bound of the overlap.  Only classes that keep a partner by this bound send their sets.

Asking.  To open a part is to compare queries with its members: the part's token union bounds each
query's overlap with any member, and only queries whose bound reaches what the smallest fitting
member needs are compared, a block at a time.  A block passes over members that are connected with
all its queries already, and reports one link for two components that it joins, so links stay below
the number of classes.  In the first round every class asks its own part, and classes of a large
group ask its first part; what that leaves apart asks the parts of its cells in the second round.

The result is what all pairs would give: sets are compared by 64-bit hashes of their shingles, and
nothing is left out, capped or sampled.

Defined cases: letters A-Z compare in lower case; a null, empty or blank text has an empty set, which
links with nothing; equal sets link (similarity 1); repeated rows are documents of one class; a null
doc_id never is a component's id unless all its documents' are null; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._bloom import bloom, probe
from rolegraph.llm._spark import connected_components, free_shuffles, keep_ids, release, row_mark, small_batches, small_enough, written
from rolegraph.llm._text import Words, binary_list, distinct_per_doc, int64, mix64, shingles, stream, text_slices

WIDTH = 5
#: The similarity as a fraction; a link needs intersection * PER >= union * TIMES.
TIMES, PER = 4, 5
COUNTERS = 1 << 22
CHUNK = 1 << 16
KEYS = 6
#: Shingles of a part, and of the queries that meet it in one task, about.
PART_TOKENS = 1 << 19
#: Classes that a task remembers having sent.
SEEN = 100_000
#: Queries that are compared at once; members that make a shingle a column of the dense part; its numbers at most.
AT_ONCE = 128
DENSE = 12
DENSE_CELLS = 8 << 20
#: Buckets of a signature at least (others have 2 to 4 shingles a bucket), and the greatest count that it holds.
BUCKETS, MOST = 32, 15
#: Counts that are compared at once, and pairs of a part and salt that are sifted one by one; past that its union decides.
SIFT_CELLS, SIFT_PAIRS = 4 << 20, 8 << 20

_SALT = stream(29, KEYS) | np.uint64(1)


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(n * TIMES / PER): shingles that a set of n must share with another to reach the similarity."""
    return (n * TIMES + PER - 1) // PER


def _doc_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_per_doc(*shingles(Words(data, offsets), width))


def class_ids(sets: np.ndarray, begin: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole set, the first of so many bits."""
    a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
    b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets + np.uint64(0x1234567)), dtype=np.uint64)))
    a, b = (mix64(x[begin[1:]] - x[begin[:-1]] + np.diff(begin).astype(np.uint64)) for x in (a, b))
    return mix64(a ^ mix64(b)) >> np.uint64(64 - bits), mix64(b + mix64(a))


class Naming:
    """How a task names classes: by the first hash, by the second where two sets share the first."""

    def __init__(self, width: int, bits: int = 64, shared: list[int] = ()):
        self.width, self.bits, self.shared = width, bits, np.sort(np.array(shared, dtype=np.int64))

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sets, where each document's begins, and its class."""
        sets, begin = _doc_sets(data, offsets, self.width)
        one, two = map(int64, class_ids(sets, begin, self.bits))
        return sets, begin, np.where(np.isin(one, self.shared), two, one) if len(self.shared) else one


def _profile(width: int, bits: int):
    """A row per document (size, both names of its class, minimum hashes), and the task's part of the sketch."""
    names = ["kind", "doc_id", "mark", "n", "one", "two", "keys", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(COUNTERS, dtype=np.int32), [], 0

        def add() -> None:
            nonlocal size
            if held:
                place, n = np.unique((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int32), return_counts=True)
                counts[place] += n.astype(np.int32)
            held.clear()
            size = 0

        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                sets, begin = _doc_sets(data, offsets, width)
                n = np.diff(begin)
                keys = np.zeros((b - a, KEYS), dtype=np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    for k in range(KEYS):
                        keys[full, k] = np.minimum.reduceat(mix64(sets * _SALT[k]), begin[:-1][full])
                held.append(sets)
                size += len(sets)
                if size > COUNTERS >> 3:
                    add()
                one, two = class_ids(sets, begin, bits)
                columns = [pa.array(np.zeros(b - a, np.int32)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(int64(one)), pa.array(int64(two))]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.arange(0, KEYS * (b - a) + 1, KEYS, dtype=np.int32)), pa.array(int64(keys.ravel()))), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names=names)
        add()
        some = np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1))
        packed = [zlib.compress(np.minimum(counts[c * CHUNK : (c + 1) * CHUNK], 255).astype(np.uint8).tobytes(), 1) for c in some]
        none = [pa.nulls(len(some), pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), *none, pa.nulls(len(some), pa.list_(pa.int64())), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return run


def _levels(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk of the sketch, summed over tasks, on a scale of quarter powers of two."""
    total = np.zeros(CHUNK, dtype=np.int64)
    for part in parts:
        for blob in part["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(blob), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(4 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())], names=["at", "levels"])


def _first_seen(seen: set[int], own: np.ndarray) -> np.ndarray:
    """Which of the classes a task meets for the first time, as far as it remembers (SEEN classes)."""
    if len(seen) > SEEN:
        seen.clear()
    return np.array([c not in seen and (seen.add(c) or True) for c in own.tolist()], dtype=bool)


def _prefixes(naming: Naming, levels, bits=None):
    """(shingle, class, n, place) of each document's prefix; bits: only of shingles that the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                sets, begin, own = naming.sets(data, offsets)
                n = np.diff(begin)
                fresh = _first_seen(seen, own) & (n > 0)
                doc = np.repeat(np.arange(len(n)), n)
                key = (levels.value[(sets & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (sets >> np.uint64(8))
                order = np.lexsort((key, doc))
                place = np.arange(len(sets)) - begin[:-1][doc]
                keep = (place < (n - least_overlap(n) + 1)[doc]) & fresh[doc]
                sets, doc, place = sets[order][keep], doc[keep], place[keep]
                if bits is not None:
                    keep = probe(bits.value, sets)
                    sets, doc, place = sets[keep], doc[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(int64(sets)), pa.array(own[doc]), pa.array(n[doc].astype(np.int32)), pa.array(place.astype(np.int32))], names=["shingle", "class", "n", "place"])

    return run


def _among(bits, function):
    """function over the rows whose third column, a hash, the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batch.filter(pa.array(probe(bits.value, batch.column(2).to_numpy().view(np.uint64)))) for batch in batches)

    return run


def _sets(naming: Naming):
    """(class, set), about once for each class of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                sets, begin, own = naming.sets(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(own), binary_list(sets, begin)], names=["class", "set"]).filter(pa.array(_first_seen(seen, own)))

    return run


def signature_sizes(n: np.ndarray) -> np.ndarray:
    """Buckets of the signatures of sets of n: powers of two, at most one step apart where two sets can be linked."""
    return np.maximum(BUCKETS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 4)).clip(0).astype(np.int64))


def signatures(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of each set fall in each of its buckets, MOST at most, two counts a byte; and where each set's bytes begin."""
    n = np.diff(begin)
    m = signature_sizes(n)
    first = np.concatenate(([0], np.cumsum(m)))
    low = sets >> np.uint64(32)  # a bucket is a run of these 32 bits, so that neighbours add up to the next coarser one
    counts = np.bincount(np.repeat(first[:-1], n) + ((low * np.repeat(m, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64), minlength=first[-1])
    counts = np.minimum(counts, MOST).astype(np.uint8)
    return counts[0::2] << 4 | counts[1::2], first // 2


def _signatures(naming: Naming):
    """(class, n, signature), about once for each class of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                sets, begin, own = naming.sets(data, offsets)
                packed = binary_list(*signatures(sets, begin))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.diff(begin)), packed], names=["class", "n", "signature"]).filter(pa.array(_first_seen(seen, own)))

    return run


def sift(size: np.ndarray, packed: list[bytes], label: np.ndarray, member: np.ndarray, own: bool) -> np.ndarray:
    """Which members and queries of a part have a partner of another label that their signatures don't rule out.

    Queries are held against members, and members against each other if own.  The overlap is at most
    the sum of the lesser counts, and what either signature holds no count for.
    """
    asks, held = np.flatnonzero(~member), np.flatnonzero(member)
    buckets = np.array([2 * len(x) for x in packed])
    raw = [np.frombuffer(x, np.uint8) for x in packed]
    fine = {int(m): np.flatnonzero(buckets == m) for m in np.unique(buckets)}
    counts = {}
    for m, at in fine.items():
        both = np.stack([raw[i] for i in at])
        counts[m] = np.stack((both >> 4, both & MOST), axis=2).reshape(len(at), m)
    place, spare = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for m, at in fine.items():
        place[at], spare[at] = np.arange(len(at)), size[at] - counts[m].sum(axis=1, dtype=np.int64)

    def coarse(at: np.ndarray, m: int, to: int) -> np.ndarray:
        return counts[m][place[at]].reshape(len(at), to, m // to).sum(axis=2, dtype=np.uint8)

    keep = np.zeros(len(size), dtype=bool)
    many = (len(asks) + own * len(held)) * len(held) > SIFT_PAIRS
    for m, at in fine.items():
        for other in (m // 2, m, 2 * m):
            to = min(m, other)
            near = fine[other][member[fine[other]]] if other in fine else at[:0]
            if not len(near):
                continue
            rows, theirs = at if own else at[~member[at]], coarse(near, other, to)
            if many:  # the members' union of counts is one partner, as small as the least of them; members stay
                most, least, extra = theirs.max(axis=0), size[near].min(), spare[near].max()
                step = max(1, SIFT_CELLS // to)
                for k in range(0, len(rows), step):
                    r = rows[k : k + step]
                    bound = np.minimum(coarse(r, m, to), most).sum(axis=1, dtype=np.int64) + spare[r] + extra
                    fits = bound * (PER + TIMES) >= (size[r] + least) * TIMES
                    keep[r[fits]] = True
                    if fits.any():
                        keep[near] = True
                continue
            step = max(1, SIFT_CELLS // (to * len(near)))
            k = 0
            rows = rows[~keep[rows] | ~member[rows]]  # a member that is kept already needs no other reason
            while k < len(rows):
                r = rows[k : k + step]
                k += step
                r = r[~keep[r] | ~member[r]]
                if not len(r):
                    continue
                bound = np.minimum(coarse(r, m, to)[:, None], theirs).sum(axis=2, dtype=np.int64) + spare[r][:, None] + spare[near]
                fits = (bound * (PER + TIMES) >= (size[r][:, None] + size[near]) * TIMES) & (label[r][:, None] != label[near])
                keep[r[fits.any(axis=1)]] = True
                keep[near[fits.any(axis=0)]] = True
    return keep


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct values."""
    return len(np.intersect1d(a, b, assume_unique=True))


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, ask_sets: list[np.ndarray], own: bool, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join components among a part's members and its queries (asks, and the members themselves if own); known: the components of ids and asks so far."""
    size = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets)
    union, column = np.unique(tokens, return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    # the bound of a query's overlap with any member is its overlap with the union
    queries = (list(zip(ids.tolist(), sets)) if own else []) + list(zip(asks.tolist(), ask_sets))
    q_size = np.array([len(s) for _, s in queries])
    q_tokens = np.concatenate([s for _, s in queries])
    q_doc = np.repeat(np.arange(len(queries)), q_size)
    at = np.searchsorted(union, q_tokens)
    at[at == len(union)] = 0
    hit = union[at] == q_tokens
    bound = np.bincount(q_doc[hit], minlength=len(queries))
    fits = np.maximum(size.min(), least_overlap(q_size))
    opened = (bound * (PER + TIMES) >= (q_size + fits) * TIMES) & (q_size * PER >= size.min() * TIMES) & (size.max() * PER >= q_size * TIMES)
    if not opened.any():
        return []
    nodes, one = np.unique(np.concatenate((ids, asks)), return_index=True)
    label = np.arange(len(nodes)) if known is None else np.unique(known[one], return_inverse=True)[1]
    member, asker = np.searchsorted(nodes, ids), np.searchsorted(nodes, np.array([k for k, _ in queries]))
    # overlaps: frequent shingles as a dense product, the others by their members
    frequency = np.bincount(column, minlength=len(union))
    dense = np.argsort(-frequency, kind="stable")[: min(DENSE_CELLS // len(ids), int((frequency >= DENSE).sum()))]
    row = np.full(len(union), -1)
    row[dense] = np.arange(len(dense))
    matrix = np.zeros((len(ids), len(dense)), dtype=np.float32)
    holder = np.repeat(np.arange(len(ids)), size)
    full = row[column] >= 0
    matrix[holder[full], row[column[full]]] = 1
    by = np.argsort(column[~full], kind="stable")
    posted, rare = holder[~full][by], column[~full][by]
    first = np.searchsorted(rare, np.arange(len(union) + 1))
    q_begin = np.concatenate(([0], np.cumsum(q_size)))
    left, out = np.flatnonzero(opened), []
    while len(left):
        left = left[np.argsort(label[asker[left]], kind="stable")]
        now = left[:AT_ONCE]
        same = now[label[asker[now]] == label[asker[now[0]]]]
        if len(same) >= AT_ONCE // 4 or len(same) == len(now):  # queries of one component pass over its members
            now = same
            some = np.flatnonzero(label[member] != label[asker[now[0]]])
        else:
            some = np.arange(len(ids))
        left = left[~np.isin(left, now)]
        if not len(some):
            continue
        take = np.concatenate([np.arange(q_begin[i], q_begin[i + 1]) for i in now])
        take = take[hit[take]]
        who, col = np.searchsorted(now, q_doc[take]) if (now[1:] > now[:-1]).all() else np.argsort(now)[np.searchsorted(np.sort(now), q_doc[take])], at[take]
        few = row[col] < 0
        asked = np.zeros((len(now), len(dense)), dtype=np.float32)
        asked[who[~few], row[col[~few]]] = 1
        overlap = asked @ matrix[some].T
        n = first[col[few] + 1] - first[col[few]]
        if n.sum():
            of = np.repeat(np.arange(len(n)), n)
            post = np.arange(len(of)) - (np.cumsum(n) - n - first[col[few]])[of]
            overlap += np.bincount(who[few][of] * len(ids) + posted[post], minlength=len(now) * len(ids)).reshape(len(now), len(ids))[:, some]
        linked = overlap * (PER + TIMES) >= (q_size[now][:, None] + size[some]) * TIMES
        for i in np.flatnonzero(linked.any(axis=1)):
            mine, met = asker[now[i]], member[some[linked[i]]]
            for other in np.unique(label[met]):
                if other != label[mine]:
                    out.append((int(nodes[mine]), int(nodes[met[label[met] == other][0]])))
                    label[label == other] = label[mine]
    return out


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part and salt; they come sorted by both."""
    key, held = None, []
    for batch in batches:
        part, salt = batch["part"].to_numpy(), batch["salt"].to_numpy()
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (salt[1:] != salt[:-1])) + 1 if len(part) else []
        for s, e in zip([0, *cuts], [*cuts, len(part)]):
            if s == e:
                continue
            if key is not None and key != (part[s], salt[s]):
                yield pa.Table.from_batches(held)
                held = []
            key = (part[s], salt[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose sets are compared, without their signatures."""
    for rows in _by_part(batches):
        member, own = rows["kind"].to_numpy() == 0, rows["own"].to_numpy()
        if member.any() and (not member.all() or own.any()):
            keep = sift(rows["n"].to_numpy(), rows["signature"].to_pylist(), rows["label"].to_numpy(), member, bool(own.any()))
            yield from rows.drop_columns(["n", "signature"]).filter(pa.array(keep)).to_batches()


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links found by opening parts; rows come sorted by part and salt, members before queries."""
    for rows in _by_part(batches):
        kind, own, ids, label = (rows[c].to_numpy() for c in ("kind", "own", "class", "label"))
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
        members, asks = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if len(members) and (len(asks) or own[members[0]] and len(members) > 1):
            found = spanning_links(ids[members], [sets[i] for i in members], ids[asks], [sets[i] for i in asks], bool(own[members[0]]), label[np.concatenate((members, asks))])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def _if_small(side: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A written side, broadcast if its rows are few enough; else Spark joins by shuffle."""
    return F.broadcast(side) if small_enough(side, row_bytes) else side


def similar_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, name_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, class) for every document, mark being row_mark() of its text, and (class, docs, doc_id, component) for every class: component is null where no other class is linked."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = rows.select("doc_id", "text", row_mark(F.col("text")).alias("mark"))
    profile = written(marked.mapInArrow(_profile(width, name_bits), "kind int, doc_id long, mark long, n long, one long, two long, keys array<long>, at int, counts binary"), "jaccard-profile")
    of_docs = profile.where("kind = 0")
    levels = np.zeros(COUNTERS, dtype=np.uint8)
    for r in profile.where("kind = 1").select("at", "counts").groupBy("at").applyInArrow(_levels, "at int, levels binary").collect():  # COUNTERS bytes in all
        levels[r["at"] * CHUNK : (r["at"] + 1) * CHUNK] = np.frombuffer(r.levels, np.uint8)
    levels = spark.sparkContext.broadcast(levels)

    def classes_of(named: DataFrame) -> DataFrame:
        full = named.where("n > 0").groupBy("class")
        return written(full.agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("keys").alias("keys"), F.count("*").alias("docs"), F.min("two").alias("low"), F.max("two").alias("high")), "jaccard-classes")

    named = of_docs.withColumn("class", F.col("one"))
    classes = classes_of(named)
    shared = [r["class"] for r in classes.where("low <> high").select("class").collect()]  # names that chance gave to two sets
    if shared:
        release(spark, classes)
        named = of_docs.withColumn("class", F.when(F.col("one").isin(shared), F.col("two")).otherwise(F.col("one")))
        classes = classes_of(named)
    naming = Naming(width, name_bits, shared)

    # shingles that prefixes of two classes hold, then the matrix's entries for those
    met = rows.mapInArrow(_prefixes(naming, levels), "shingle long, class long, n int, place int")
    met = met.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("shingle")
    met = written(met, "jaccard-shingles")
    free_shuffles(spark)
    bits = spark.sparkContext.broadcast(bloom(met))
    entries = written(rows.mapInArrow(_prefixes(naming, levels, bits), "shingle long, class long, n int, place int"), "jaccard-entries")
    release(spark, met)

    # groups: the minimum hash that most classes share; parts of about PART_TOKENS shingles
    some = written(classes.join(entries.select("class").distinct(), "class", "left_semi").select("class", "n", "keys"), "jaccard-some")
    keyed = some.select("class", F.posexplode("keys").alias("k", "hash"))
    popular = written(keyed.groupBy("k", "hash").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-popular")
    chosen = keyed.join(_if_small(popular), ["k", "hash"]).groupBy("class").agg(F.max(F.struct("c", "k", "hash")).alias("top"))
    grouped = written(some.join(chosen, "class", "left").select("class", "n", F.when(F.col("top").isNull(), F.col("class")).otherwise(F.xxhash64("top.k", "top.hash")).alias("group")), "jaccard-groups")
    large = grouped.groupBy("group").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > PART_TOKENS)
    large = written(large.select("group", F.ceil(F.col("tokens") / PART_TOKENS).alias("cuts")), "jaccard-large")
    place = F.pmod(F.xxhash64("class"), F.coalesce("cuts", F.lit(1)))
    members = grouped.join(_if_small(large), "group", "left").withColumn("place", place)
    part = lambda place: F.when(F.col("cuts").isNull(), F.col("group")).otherwise(F.xxhash64("group", place))
    members = written(members.select("class", "n", "group", part(F.col("place")).alias("part"), part(F.lit(0).cast("long")).alias("first")), "jaccard-members")
    release(spark, some, popular, grouped, large)

    # the matrix, of the shingles that several parts hold, and its cells
    placed = entries.join(_if_small(members.select("class", "part")), "class").select("shingle", "part", "n", (F.col("n") - F.col("place")).alias("room"))
    placed = written(placed, "jaccard-placed")  # so that entries move by class once
    release(spark, entries)
    free_shuffles(spark)
    across = placed.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("shingle")
    across = written(across, "jaccard-across")
    matrix = placed.join(_if_small(across), "shingle", "left_semi").groupBy("shingle", "part").agg(F.max("room").alias("room"), F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = written(matrix, "jaccard-matrix")
    release(spark, placed, across)
    free_shuffles(spark)
    a, b = (matrix.select("shingle", *(F.col(x).alias(f"{x}_{s}") for x in ("part", "room", "low", "high"))) for s in "ab")
    fit = f"part_a < part_b and least(room_a, room_b) * {PER + TIMES} >= (low_a + low_b) * {TIMES} and high_a * {PER} >= low_b * {TIMES} and high_b * {PER} >= low_a * {TIMES}"
    cells = written(a.join(b, "shingle").where(fit).select("part_a", "part_b").distinct(), "jaccard-cells")
    release(spark, matrix)
    parts = members.groupBy("part").agg(F.count("*").alias("size"), F.min("first").alias("first"))
    asked = cells.select(F.explode(F.array("part_a", "part_b")).alias("part")).distinct()
    parts = written(parts.join(asked.withColumn("asked", F.lit(True)), "part", "left").where("asked or size > 1").drop("asked"), "jaccard-part-list")
    sizes = members.select("class", "n")

    def read_again(wanted: DataFrame, function, schema: str, name: str) -> DataFrame:
        """What function makes of the texts of the wanted classes, each from one of its documents.

        Texts never move: where the ids are too many to broadcast, a filter of them lets some more texts
        in, whose classes the joins that follow leave out, or which repeat the row of a wanted class.
        """
        ids = written(classes.join(wanted, "class", "left_semi").select("doc_id"), "jaccard-wanted")
        if small_enough(ids):
            found = keep_ids(rows, ids, "left_semi").mapInArrow(function, schema)
        else:
            hashed = F.xxhash64("doc_id").alias("hash")  # of a null as well
            some = spark.sparkContext.broadcast(bloom(ids.select(hashed)))
            found = rows.select("doc_id", "text", hashed).mapInArrow(_among(some, function), schema)
        out = written(found, name)
        release(spark, ids)
        free_shuffles(spark)
        return out

    # signatures of the classes that some part or cell compares
    marks = read_again(members.join(parts.select("part"), "part", "left_semi").select("class"), _signatures(naming), "class long, n long, signature binary", "jaccard-signatures")

    def opened(asks: DataFrame, own: bool, told: DataFrame | None = None) -> DataFrame:
        """Links from opening parts: asks is a written table (class, part); own: members ask their own part too; told: members with the labels they have."""
        many = asks.join(sizes, "class").groupBy("part").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > PART_TOKENS)
        many = _if_small(written(many.select("part", F.ceil(F.col("tokens") / PART_TOKENS).cast("int").alias("salts")), "jaccard-salts"))
        open_ = parts.where("size > 1").select("part").union(asks.select("part")).distinct() if own else asks.select("part").distinct()
        salts = F.coalesce("salts", F.lit(1))
        held = members.select("class", "part").join(open_, "part", "left_semi").join(many, "part", "left").select("part", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "class")
        held = held.select("part", "salt", F.lit(0).alias("kind"), (F.lit(own) & (F.col("salt") == 0)).alias("own"), "class")
        asking = asks.join(many, "part", "left").select("part", F.pmod(F.xxhash64("class"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(False).alias("own"), "class")
        lines = held.union(asking)
        lines = lines.withColumn("label", F.col("class")) if told is None else lines.join(_if_small(told.select("class", "label")), "class")
        lines = written(lines, "jaccard-lines")  # narrow, so that signatures move once
        narrow = ["part", "salt", "kind", "own", "class", "label"]
        dealt = lambda full: full.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind")
        kept = dealt(marks.join(_if_small(lines), "class").select(*narrow, "n", "signature")).mapInArrow(_sift, lines.select(*narrow).schema)
        kept = written(kept, "jaccard-kept")
        sets = read_again(kept.select("class"), _sets(naming), "class long, set binary", "jaccard-sets")
        out = written(dealt(sets.join(_if_small(kept), "class").select(*narrow, "set")).mapInArrow(_open, "a long, b long"), "jaccard-links")
        release(spark, lines, kept, sets)
        free_shuffles(spark)
        return out

    asks = written(members.where("part <> first").select("class", F.col("first").alias("part")), "jaccard-asks")
    links = opened(asks, True)
    components = connected_components(links, "jaccard-components")
    release(spark, asks)
    told = members.select("class", "part").join(components.withColumnRenamed("node", "class"), "class", "left").select("class", "part", F.coalesce("component", "class").alias("label"))
    told = written(told, "jaccard-told")
    state = told.groupBy("part", "label").agg(F.count("*").alias("c")).groupBy("part").agg(F.max(F.struct("c", "label"))["label"].alias("main"), (F.count("*") == 1).alias("pure"), F.sum("c").alias("size"))
    state = written(state.join(parts.select("part", "first"), "part"), "jaccard-state")
    side = lambda s: state.select(*(F.col(x).alias(f"{x}_{s}") for x in state.columns))
    apart = cells.join(side("a"), "part_a").join(side("b"), "part_b").where("not (first_a = first_b and (part_a = first_a or part_b = first_b)) and not (main_a = main_b and pure_a and pure_b)")
    small = "(size_a < size_b or (size_a = size_b and part_a < part_b))"
    ways = apart.select(
        F.explode(
            F.array(
                F.when(F.expr(f"main_a = main_b and not pure_a or main_a <> main_b and {small}"), F.struct(F.col("part_a").alias("source"), F.col("part_b").alias("part"), F.col("main_b").alias("main"), F.col("pure_b").alias("pure"), F.expr("main_a = main_b").alias("same"))),
                F.when(F.expr(f"main_a = main_b and not pure_b or main_a <> main_b and not {small}"), F.struct(F.col("part_b").alias("source"), F.col("part_a").alias("part"), F.col("main_a").alias("main"), F.col("pure_a").alias("pure"), F.expr("main_a = main_b").alias("same"))),
            )
        ).alias("w")
    ).where("w is not null").select("w.*")
    asks = ways.join(told.select(F.col("part").alias("source"), "class", "label"), "source").where("not ((same or pure) and label = main)").select("class", "part")
    asks = written(asks, "jaccard-asks")
    if asks.limit(1).count():
        more = opened(asks, False, told)
        both = written(links.union(more), "jaccard-links")
        release(spark, links, more, components)
        links, components = both, connected_components(both, "jaccard-components")
    release(spark, asks, told, state, links, cells, parts, marks, members)
    out = written(classes.select("class", "docs", "doc_id").join(_if_small(components.withColumnRenamed("node", "class")), "class", "left"), "jaccard-linked")
    release(spark, components, classes)
    return named.select("doc_id", "mark", "n", "class"), out


def marked_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, name_bits: int = 64) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id): one row per document, mark being row_mark() of its text."""
    of_docs, classes = similar_classes(docs, text, key, width, name_bits)
    # minima over classes, not over documents; then only classes with company need a lookup
    least = classes.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    several = classes.where("docs > 1 and component is null").select("class", F.col("doc_id").alias("component_id"))
    several = several.union(classes.join(_if_small(written(least, "jaccard-least")), "component").select("class", "component_id"))
    several = written(several, "jaccard-several")
    release(docs.sparkSession, classes)
    side = _if_small(several.select("class", "component_id", F.lit(True).alias("found")))
    out = of_docs.join(side, (of_docs["class"] == side["class"]) & (of_docs["n"] > 0), "left")
    return out.select(of_docs["doc_id"], "mark", F.col("n").alias("n_shingles"), F.when(F.col("found"), F.col("component_id")).otherwise(of_docs["doc_id"]).alias("component_id"))


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, name_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document."""
    return marked_components(docs, text, key, width, name_bits).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The rows of docs without those linked to a document with a smaller doc_id: one of each component stays.

    A null doc_id counts as greater than any other; rows that share the smallest doc_id, and rows of a
    component that has no other doc_id than null, all stay.
    """
    found = marked_components(docs, text, key, width).where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    gone = written(found.select("doc_id", "mark").distinct(), "jaccard-gone")
    return keep_ids(docs, gone, "left_anti", key, text)

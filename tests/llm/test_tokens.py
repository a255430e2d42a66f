import zlib

import numpy as np
import pytest

from rolegraph.llm import packing, token_files
from rolegraph.llm._tokens import Encoder

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


ODD = ["It's a Test<|endoftext|> İstanbul ΣΑΣ é ﬁ x² ½ don't WE'LL 12,345.67 —dash…", "", "   ", "a\tb\x0bc\x1cd", "ÀÉ'S ǅ ŉ ÷×", "C'EST l'été 3×4 é ​日本語テスト", "\x00 \x7f \u0085x"]


def test_encoder_equals_the_library(reference):
    e = Encoder(PATH)
    assert e.units
    for text in ODD:
        assert e.encode_text(text) == reference(text), text


def test_cache_starts_afresh(reference, monkeypatch):
    e = Encoder(PATH)
    monkeypatch.setattr("rolegraph.llm._tokens.CACHE_UNITS", 8)
    e.clear()
    for text in ("one two three", "four five six", "seven, eight nine", "one ten", "a b c d e f g h i j k l m n one"):
        assert e.encode_text(text) == reference(text)


@pytest.mark.parametrize("range_bytes, shard_bytes", [(60_000, 9_000), (1 << 20, 1 << 20), (1_000, 1 << 20)])
def test_files_round_trip(docs, no_docs, reference, monkeypatch, range_bytes, shard_bytes):
    monkeypatch.setattr(token_files, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard_bytes)
    got = [tuple(r) for r in token_files.token_round_trip(docs, PATH, 2).collect()]
    rows = sorted(((r.doc_id, reference(r.text) + [2]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = [], 0
    for k, ids in rows:
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert token_files.token_round_trip(no_docs, PATH, 2).count() == 0


def test_a_broken_record_is_seen():
    record = bytearray(token_files.frame(b"abcdef"))
    assert token_files.unframe(bytes(record), 0) == (b"abcdef", len(record))
    for i in range(len(record)):
        bad = bytearray(record)
        bad[i] ^= 1
        with pytest.raises((ValueError, Exception)):
            token_files.unframe(bytes(bad), 0)


def test_packing_keeps_every_id(docs, no_docs, reference):
    pieces = packing.pack(docs, PATH, 1).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(reference(r.text) + [1])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        ids = texts[p.doc_id][0]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    for k, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, texts[k]))
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(no_docs, PATH, 1).count() == 0


def test_padding_is_little(spark):
    from .conftest import prose

    docs = spark.createDataFrame([(i, prose(i, 20 + 37 * i % 900)) for i in range(400)], "doc_id long, text string").coalesce(1)
    sizes = [r.n for r in packing.pack(docs, PATH, 1).groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in sizes)
    assert padded <= 1.02 * sum(sizes)


def test_cuts_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(30):
        width = 32
        at = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 15, 25)))))
        penalty = rng.choice([0, 4, 48], len(at))
        penalty[[0, -1]] = 0
        pad = lambda n: 0 if n & (n - 1) == 0 and n >= 4 else width - n
        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= width) + penalty[j] + packing.EACH
        cuts = packing.best_cuts(at, penalty, width, 4, tail=10**9)
        cost = sum(pad(int(at[j] - at[i])) + penalty[j] + packing.EACH for i, j in zip(cuts, cuts[1:]))
        assert cost == best[-1]

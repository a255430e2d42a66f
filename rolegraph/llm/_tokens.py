"""Token ids of whole documents with a public tokenizer, a slice of documents at a time.

Texts repeat their words, so a slice is cut into units that the tokenizer treats on their own, each
distinct unit is encoded once per worker with the tokenizers library, and the ids of a document are
gathered from its units.  Cutting at white space is right for any tokenizer that drops it; inside a
chunk of plain Latin-1 text the runs of letters, single digits and runs of other signs are units too.
Chunks with anything else (apostrophes, '<', other scripts) go to the unchanged tokenizer.
"""

from __future__ import annotations

import os

import numpy as np

from rolegraph.llm._text import LOWER, Words, mix64, on_idle, span_hashes, stream

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct units that a worker remembers; beyond it starts afresh, so memory is bounded.
CACHE_UNITS = 400_000

_RAW = stream(17, 256)
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_KIND[48:58] = _DIGIT
_ODD = np.zeros(256, dtype=bool)  # bytes outside the units' plain alphabet
_ODD[:9] = _ODD[14:32] = _ODD[127:] = True
_ODD[0x80:0xC0] = False  # what follows a leading byte
_ODD[0xC3] = False
_ODD[[0x27, 0x3C]] = True

_PROBE = "Ab, cd... ef1 234x É-Ö ßü ?! (x)y a_b C3PO über-Maß l.o.l 50% $9.99 ÀÉîõ #tag a/b|c"


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.idle = 0  # batches of other work since the last use
        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)  # the last id of a unit
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.stops = np.zeros(len(self.closes), dtype=bool)  # an id whose last sign is a full stop, question or exclamation mark
        self.stops[[i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        del vocab
        self.units = self.closes.any()
        if self._ids("a b c") != sum(map(self._ids, "abc"), []):
            raise ValueError("the tokenizer keeps white space; documents can't be encoded chunk by chunk")
        self.clear()
        if self.units and self.encode_text(_PROBE) != self._ids(_PROBE):
            self.units = False
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.full.encode(text, add_special_tokens=False).ids

    def encode_text(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0].tolist()

    def clear(self, room: int = 0) -> None:
        self.slots = np.zeros(4 * max(CACHE_UNITS, room), dtype=np.uint64)  # a hash table of keys with linear probing; 0 is free
        self.row = np.zeros(len(self.slots), dtype=np.int32)
        self.pool = np.empty(1 << 16, dtype=self.dtype)
        self.at, self.length, self.used, self.known = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = (keys % np.uint64(len(self.slots))).astype(np.int64)
        there = self.slots[slot]
        rows = np.where(there == keys, self.row[slot], np.int32(-1)).astype(np.int64)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) % len(self.slots)
            there = self.slots[at]
            hit = there == keys[open_]
            rows[open_[hit]] = self.row[at[hit]]
            more = ~hit & (there != 0)
            open_, at = open_[more], at[more]
        return rows

    def _remember(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        rows = self.known
        while rows + len(keys) > len(self.at):
            self.at, self.length = np.resize(self.at, 2 * len(self.at)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[rows : rows + len(keys)] = self.used + np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.length[rows : rows + len(keys)] = lengths
        self.used += len(ids)
        self.known += len(keys)
        left, at = np.arange(len(keys)), (keys % np.uint64(len(self.slots))).astype(np.int64)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = keys[left[free]]
            own = free & (self.slots[at] == keys[left])
            self.row[at[own]] = rows + left[own]
            left, at = left[~own], (at[~own] + 1) % len(self.slots)

    def _learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        spans = list(zip(starts.tolist(), ends.tolist()))
        plain = np.flatnonzero(~odd)
        if len(plain):
            texts = [b" ".join(raw[s:e] for s, e in (spans[i] for i in plain[k : k + 500].tolist())).decode() for k in range(0, len(plain), 500)]
            # a few at a time: the library keeps much more than ids of what it is encoding
            ids = np.concatenate([np.array(x.ids, dtype=self.dtype) for k in range(0, len(texts), 8) for x in self.plain.encode_batch_fast(texts[k : k + 8], add_special_tokens=False)])
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(plain):
                raise RuntimeError("a unit was not encoded on its own")
            self._remember(keys[plain], ids, np.diff(stops, prepend=0))
        rest = np.flatnonzero(odd)
        if len(rest):
            got = [x.ids for x in self.full.encode_batch_fast([raw[s:e].decode() for s, e in (spans[i] for i in rest.tolist())], add_special_tokens=False)]
            self._remember(keys[rest], np.array([i for x in got for i in x], dtype=self.dtype), np.array([len(x) for x in got], dtype=np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's documents one after another, and where each document's begin."""
        self.idle = 0
        n, chunks = len(data), Words(data, offsets, hashed=False)
        starts, ends = chunks.starts, chunks.ends
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        if self.units:
            trail = np.zeros(n, dtype=np.uint8)
            trail[1:] = np.where(data[:-1] == 0xC3, data[1:], 0)
            bad = _ODD[data] | (trail == 0x97) | (trail == 0xB7)
            total = np.concatenate(([0], np.cumsum(bad)))
            odd = total[ends] > total[starts]
            inside = np.zeros(n + 1, dtype=np.int8)
            inside[starts[odd]] = 1
            inside[ends[odd]] -= 1
            inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
            kind = _KIND[data]
            begins = np.zeros(n, dtype=bool)
            begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            begins &= ~inside & (kind != 0)
            begins[starts] = True
            stops = np.zeros(n + 1, dtype=bool)
            stops[:n] = begins
            stops[ends] = True
            low = LOWER[data]
            low += np.where((trail >= 0x80) & (trail <= 0x9E) & (trail != 0x97), 32, 0).astype(np.uint8)
            low = np.where(inside, data, low)
            starts = np.flatnonzero(begins)
            stops[starts[0]] = False
            ends = np.flatnonzero(stops)
            ends = ends[np.searchsorted(ends, starts, side="right")]
            odd = inside[starts]
        else:
            low, odd = data, np.ones(len(starts), dtype=bool)
        keys = span_hashes(low, starts, ends, _RAW)
        keys = np.where(odd, mix64(keys), keys)
        keys[keys == 0] = 1
        rows = self._find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            unique, first = np.unique(keys[new], return_index=True)
            if self.known + len(unique) > CACHE_UNITS:
                new = np.arange(len(keys))
                unique, first = np.unique(keys, return_index=True)
                self.clear(len(unique))  # one huge document may need more than CACHE_UNITS
            first = new[first]
            self._learn(unique, low.tobytes(), starts[first], ends[first], odd[first])
            rows[new] = self._find(keys[new])
        lengths = self.length[rows]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.pool[np.repeat(self.at[rows] - sums[:-1], lengths) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(starts, offsets)]


#: Bytes of text that are encoded at once.
PIECE = 1 << 18
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _forget() -> None:
    """Let go of encoders that this worker's present tasks don't use."""
    for path, e in list(_encoders.items()):
        e.idle += 1
        if e.idle > 2:
            del _encoders[path]


on_idle.append(_forget)


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with one id more at the end of each."""
    docs = len(begin) - 1
    out = np.empty(len(ids) + docs, dtype=ids.dtype)
    stops = begin[1:] + np.arange(docs)
    own = np.ones(len(out), dtype=bool)
    own[stops] = False
    out[own], out[stops] = ids, end_id
    return out, begin + np.arange(docs + 1)

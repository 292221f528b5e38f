"""Token ids in files, compressed by a context-mixing range coder.

A block holds the ids of whole documents and is decoded by itself: every model starts anew in it, and a CRC-32 of its ids
is checked on reading. Ids are predicted by three models: order 2 (what followed the last two ids), order 1 (what followed
the last id) and order 0 (how often an id has occurred). Orders 2 and 1 each name one candidate and a confidence, a count that
rises with every hit and falls with every miss; a candidate without any left is replaced. The chances of the two candidates mix, in
the logistic domain and with weights that adapt, how often candidates of their confidences were right in this block; what
the pair of confidences itself has shown then takes over from the mixture. The rest of the range belongs to order 0. So each id is
one step of the range coder.

A block is cut into lanes that are coded side by side, one id of each lane at a time, with models that all lanes of the block
share; every lane has its own range coder. So each step is array arithmetic over all lanes of several blocks, and mixing,
which depends on the confidences only, is done once for a run of steps. All of it is integer arithmetic, so that blocks decode
alike on every machine.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, save, slices, text_buffer
from .hashing import word_spans

#: Ids after which a block is closed (at the end of a document), and ids of a lane.
BLOCK_IDS = 1 << 17
LANE_IDS = 512
#: Blocks coded together.
TOGETHER = 16
END_ID = 1
VERSION = 2

#: Slots of order 1 and order 2 in a block, and confidences.
_T1, _T2, _SURE = 1 << 16, 1 << 16, 16
#: Bits of order 0's frequencies and of the chances of the candidates: together those of the coder's range.
_ORDER0_BITS, _CHANCE_BITS = 22, 10
_WHOLE = 1 << _CHANCE_BITS
#: Logarithm of the cells in which a decoder looks up order 0.
_CELLS = 13
#: Steps after which the chances are mixed anew, and after which order 0 takes up the ids seen since.
_MIX, _REFRESH = 16, 64
#: Confidence after a hit and after a miss.
_UP = np.minimum(np.arange(_SURE, dtype=np.int32) + 1, _SURE - 1)
_DOWN = np.arange(_SURE, dtype=np.int32) // 2
_U = np.uint64
_BITS = _U(_ORDER0_BITS + _CHANCE_BITS)
_TOP = _U(1) << _U(32)
_LOW = _TOP - _U(1)


@lru_cache(1)
def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """stretch of a 12-bit probability, in units of 1/256, and squash of a stretch + 2047 as a 12-bit probability."""
    stretch = np.array([round(256 * math.log((p + 0.5) / (4096 - p - 0.5))) for p in range(4096)], dtype=np.int64)
    squash = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int64)
    return stretch, squash


class _Coder:
    """Range coders, one for each lane: 64-bit low and range, 32 bits at a time, no carry. Each step is for the first m lanes."""

    def __init__(self, lanes: int, words: list[np.ndarray] | None = None):
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, ~_U(0))
        self.decoding = words is not None
        if words is None:
            self.out = np.zeros((lanes, 64), np.uint32)
            self.n = np.zeros(lanes, np.int64)
        else:
            zeros = np.zeros(2, np.uint32)  # behind each lane's words
            self.data = np.concatenate([x for w in words for x in (w, zeros)]).astype(_U)
            size = np.array([len(w) + 2 for w in words], dtype=np.int64)
            self.at = np.cumsum(size) - size
            self.end = np.cumsum(size) - 1
            self.code = self.data[self.at] << _U(32) | self.data[self.at + 1]
            self.at += 2

    def narrow(self, start: np.ndarray, size: np.ndarray, unit: np.ndarray | None = None) -> None:
        """Narrow each lane to [start, start + size) of 2**_BITS."""
        m = len(start)
        low, span = self.low[:m], self.range[:m]
        if unit is None:
            unit = span >> _BITS
        low += unit * start
        np.multiply(unit, size, out=span)
        at = np.flatnonzero((span < _TOP) | ((low ^ (low + span)) < _TOP))
        if len(at):
            lo, r = low[at], span[at]
            # a range that straddles a word's end and has become small is cut at that end
            straddles = (lo ^ (lo + r)) >= _TOP
            r = np.where(straddles, (_TOP - (lo & _LOW)) & _LOW, r)
            if self.decoding:
                self.code[at] = self.code[at] << _U(32) | self.data[np.minimum(self.at[at], self.end[at])]
                self.at[at] += 1
            else:
                n = self.n[at]
                if n.max() + 1 >= self.out.shape[1]:
                    self.out = np.concatenate((self.out, np.zeros_like(self.out)), axis=1)
                self.out[at, n] = (lo >> _U(32)).astype(np.uint32)
                self.n[at] = n + 1
            low[at], span[at] = lo << _U(32), np.maximum(r, _U(1)) << _U(32)

    def target(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each lane's code in 2**_BITS, unit of its range)."""
        unit = self.range[:m] >> _BITS
        return np.minimum((self.code[:m] - self.low[:m]) // unit, (_U(1) << _BITS) - _U(1)), unit

    def finish(self) -> list[np.ndarray]:
        # a range is 2**32 at least, so it holds a value that ends in 32 zeros
        self.out[np.arange(len(self.n)), self.n] = ((self.low >> _U(32)) + ((self.low & _LOW) > 0)).astype(np.uint32)
        return [x[: n + 1].copy() for x, n in zip(self.out, self.n.tolist(), strict=True)]


class _Order0:
    """How often each id has occurred in each of several blocks, as whole frequencies that sum to 2**_ORDER0_BITS."""

    def __init__(self, blocks: int, ids: int, searched: bool):
        self.ids, self.searched = ids, searched
        self.count = np.ones((blocks, ids), np.int64)
        self.seen: list[np.ndarray] = []
        self.start = np.zeros((blocks, ids + 1), np.int32)
        self.block = np.arange(blocks, dtype=np.int32)[:, None] << _ORDER0_BITS + 1
        self._tabulate()

    def _tabulate(self) -> None:
        """Each id has one at least, the rest by count."""
        whole = 1 << _ORDER0_BITS
        unit = ((whole - self.ids) << 16) // self.count.sum(axis=1, keepdims=True)
        size = 1 + (self.count * unit >> 16)
        size[:, 0] += whole - size.sum(axis=1)
        np.cumsum(size, axis=1, out=self.start[:, 1:])
        self.flat = self.start.ravel()
        if self.searched:
            self.ordered = (self.start + self.block).ravel()
            cells = np.arange(1 << _CELLS, dtype=np.int32) << _ORDER0_BITS - _CELLS
            self.cell = np.searchsorted(self.ordered, (self.block + cells).ravel(), side="right") - 1

    def see(self, place: np.ndarray, step: int) -> None:
        """place: block * (ids + 1) + id"""
        self.seen.append(place)
        if step & (step - 1) == 0 or step % _REFRESH == 0:
            times = np.bincount(np.concatenate(self.seen), minlength=self.start.size).reshape(self.start.shape)
            self.count += 32 * times[:, :-1]
            self.seen = []
            self._tabulate()

    def find(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place of the id whose frequencies hold the target: from the first id of the target's cell a step or two, else by search."""
        place = self.cell[(block << _CELLS) + (target >> _ORDER0_BITS - _CELLS)]
        whole = (target + (block << _ORDER0_BITS + 1)).astype(np.int32)
        place += self.ordered[place + 1] <= whole
        far = np.flatnonzero(self.ordered[place + 1] <= whole)
        place[far] = np.searchsorted(self.ordered, whole[far], side="right") - 1
        return place


class _Mixer:
    """Chances of the two candidates for each block and pair of confidences: order 2's, and order 1's if that is not it."""

    def __init__(self, blocks: int):
        shape = (blocks, 2, _SURE, _SURE)  # block, whether the candidates agree, confidence of order 2, of order 1
        self.times, self.hits = np.zeros(shape, np.int64), np.zeros((2, *shape), np.int64)  # hits: of order 2; of order 1
        self.weights = np.full((2, blocks, 2, 3), 1 << 15, np.int64)  # 16-bit fractions; by decision, block, agreement: order 2, order 1, bias
        self.weights[..., 2] = 0
        self.seen: list[np.ndarray] = []
        self._mix()

    def _mix(self) -> None:
        stretch, squash = _logistic()
        times, chances = self.times, []
        for d in (0, 1):
            hits = self.hits[d]
            inputs = []
            for axis in (3, 2):  # what each model's confidence alone has shown
                rate = (hits.sum(axis=(1, axis), keepdims=True) * 4096 + 205) // (times.sum(axis=(1, axis), keepdims=True) + 1)
                inputs.append(stretch[np.minimum(4095, rate)])
            w = self.weights[d][:, :, None, None, :]
            x = np.clip((w[..., 0] * inputs[0] + w[..., 1] * inputs[1] + (w[..., 2] << 8)) >> 16, -2047, 2047)
            p = squash[x + 2047]
            chances.append((p * 32 + hits * 4096) // (32 + times))
            # weights move against the mixture's error on what has been seen
            error, n = hits * 4096 - times * p, np.maximum(1, times.sum(axis=(2, 3)))
            for j, x in enumerate((*inputs, np.full((1, 1, 1, 1), 256))):
                self.weights[d][..., j] += (error * x >> 4).sum(axis=(2, 3)) // n >> 2
            np.clip(self.weights[d], -(1 << 17), 1 << 17, out=self.weights[d])
            times = times - hits
        two = np.clip(chances[0] >> 12 - _CHANCE_BITS, 1, _WHOLE - 64)
        one = np.clip(chances[1] * (_WHOLE - two) >> 12, 1, _WHOLE - 32 - two)
        one[:, 1] = 0  # the same candidate
        self.packed = (two << 16 | one).ravel()

    def see(self, context: np.ndarray, two: np.ndarray, one: np.ndarray, step: int) -> None:
        self.seen.append(context * 3 + two + 2 * one)
        if step <= _MIX or step % _MIX == 0:
            found = np.bincount(np.concatenate(self.seen), minlength=3 * self.times.size).reshape(*self.times.shape, 3)
            self.times += found.sum(axis=-1)
            self.hits += np.moveaxis(found[..., 1:], -1, 0)
            self.seen = []
            self._mix()


def _learn(table: np.ndarray, slot: np.ndarray, entry: np.ndarray, right: np.ndarray, ids: np.ndarray) -> None:
    """A candidate gains or loses confidence; one without any is replaced by the id that came."""
    sure = entry & _SURE - 1
    table[slot] = np.where(right | (sure > 0), entry - sure + np.where(right, _UP[sure], _DOWN[sure]), ids * _SURE + 1)


def _code(ids_of: list[np.ndarray] | None, counts: list[int], words: list[list[np.ndarray]] | None, vocabulary: int):
    """Encode (ids_of given) or decode (words given) some blocks of so many ids; the same steps either way."""
    lanes = [max(1, -(-n // LANE_IDS)) for n in counts]
    block = np.repeat(np.arange(len(counts)), lanes)
    number = np.concatenate([np.arange(k) for k in lanes])
    length = np.minimum(LANE_IDS, np.array(counts)[block] - number * LANE_IDS)
    start = np.repeat(np.cumsum([0, *counts[:-1]]), lanes) + number * LANE_IDS
    # the longest lanes first, so that the lanes of a step are the first ones
    order = np.argsort(-length, kind="stable")
    block, length, start = block[order], length[order], start[order]
    place = np.minimum(start + np.arange(int(length.max(initial=0)))[:, None], max(0, sum(counts) - 1))
    flat = np.concatenate(ids_of).astype(np.int64) if ids_of is not None else np.zeros(sum(counts), np.int64)
    at = flat[place] if words is None else np.zeros(place.shape, np.int64)
    given = None if words is None else [w for x in words for w in x]
    coder = _Coder(len(block), None if given is None else [given[i] for i in order])
    zero, mixer = _Order0(len(counts), vocabulary, words is not None), _Mixer(len(counts))
    next1, next2 = np.zeros(len(counts) * _T1, np.int32), np.zeros(len(counts) * _T2, np.int32)
    base1, base2, base0, mixing = block * _T1, block * _T2, block * (vocabulary + 1), block * (2 * _SURE * _SURE)
    one, two = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    for step, ids in enumerate(at):
        m = int(np.searchsorted(-length, -step, side="left"))
        ids, one, two = ids[:m], one[:m], two[:m]
        s1 = base1[:m] + (one & _T1 - 1)
        s2 = base2[:m] + ((one * 40503 + two * 30011 >> 3) & _T2 - 1)
        e1, e2 = next1[s1], next2[s2]
        c1, c2 = e1 >> 4, e2 >> 4
        context = mixing[:m] + ((c1 == c2) * _SURE + (e2 & _SURE - 1)) * _SURE + (e1 & _SURE - 1)
        chances = mixer.packed[context]
        p2, p1 = chances >> 16, chances & 0xFFFF
        known = p2 + p1
        rest = _WHOLE - known
        if words is None:
            hit2 = ids == c2
            hit1 = (ids == c1) & ~hit2
            where = base0[:m] + ids
        else:
            target, unit = coder.target(m)
            target = target.astype(np.int64)
            hit2 = target < p2 << _ORDER0_BITS
            hit1 = (target < known << _ORDER0_BITS) & ~hit2
            miss = np.flatnonzero(~(hit2 | hit1))
            ids[:] = np.where(hit2, c2, c1)
            where = base0[:m] + ids
            where[miss] = zero.find(block[miss], (target[miss] - (known[miss] << _ORDER0_BITS)) // rest[miss])
            ids[miss] = where[miss] - base0[miss]
        first = zero.flat[where]
        begin = np.where(hit2, 0, np.where(hit1, p2 << _ORDER0_BITS, (known << _ORDER0_BITS) + rest * first))
        size = np.where(hit2, p2 << _ORDER0_BITS, np.where(hit1, p1 << _ORDER0_BITS, rest * (zero.flat[where + 1] - first)))
        coder.narrow(begin.view(_U), size.view(_U), None if words is None else unit)
        _learn(next1, s1, e1, ids == c1, ids)
        _learn(next2, s2, e2, hit2, ids)
        mixer.see(context, hit2, hit1, step + 1)
        zero.see(where, step + 1)
        one, two = ids, one
    if words is None:
        found, bounds = [None] * len(block), np.cumsum([0, *lanes])
        for i, lane in zip(order.tolist(), coder.finish(), strict=True):
            found[i] = lane
        return [found[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    inside = np.arange(len(at))[:, None] < length
    flat[place[inside]] = at[inside]
    return np.split(flat, np.cumsum(counts)[:-1])


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """A payload for each block: version, vocabulary, ids, CRC-32, words of each lane, the lanes."""
    out = []
    for a in range(0, len(blocks), TOGETHER):
        some = blocks[a : a + TOGETHER]
        for ids, lanes in zip(some, _code(some, [len(x) for x in some], None, vocabulary), strict=True):
            head = np.array([VERSION, vocabulary, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(lanes), *map(len, lanes)], dtype="<u4")
            out.append(head.tobytes() + np.concatenate(lanes).astype("<u4").tobytes())
    return out


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload. A version or checksum that does not fit is an error."""
    out = []
    for a in range(0, len(payloads), TOGETHER):
        heads, lanes = [], []
        for payload in payloads[a : a + TOGETHER]:
            words = np.frombuffer(payload, dtype="<u4")
            if words[0] != VERSION:
                raise ValueError(f"block of version {words[0]}")
            k = int(words[4])
            sizes = words[5 : 5 + k].astype(np.int64)
            heads.append(words[:4])
            lanes.append(np.split(words[5 + k :], np.cumsum(sizes)[:-1]))
        found = _code(None, [int(h[2]) for h in heads], lanes, int(heads[0][1]))
        for head, ids in zip(heads, found, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != head[3]:
                raise ValueError("a block's checksum is wrong")
            out.append(ids)
    return out


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII characters other than letters, digits, white space, controls and the apostrophe, which begins short forms.
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordEncoder:
    """Ids of whole texts by a tokenizers file of lower-case words that drops white space. No token crosses white space, or stands on
    both sides of a place where ASCII letters and marks meet (added tokens apart), so the pieces between are encoded once and
    remembered by their 64-bit hashes, the first ``most`` that a worker meets."""

    def __init__(self, path: str, most: int = 4_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.vocabulary, bool)  # ids that end a pre-token
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.most = most
        # pieces known for long, and of late: sorted hashes, where the ids of each begin, how many they are
        self.known = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids = np.zeros(1 << 16, "<u4")
        self.n = 0

    def _plain(self, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of so many words of ASCII letters, between spaces, and how many each has). Each is one pre-token, so its end shows."""
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == words else self._one_by_one(text.split())

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), dtype="<u4"), np.array(list(map(len, found)), dtype=np.int64)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces of data begin and how many they are; hashes: ascending."""
        letters = np.append(0, np.cumsum(_LETTER[data]))
        plain = letters[ends] - letters[starts] == ends - starts
        parts = []
        for a in range(0, len(hashes), 2000):
            some = a + np.flatnonzero(plain[a : a + 2000])
            if len(some):
                size = ends[some] - starts[some] + 1
                before = np.cumsum(size) - size
                spaced = np.append(data, np.uint8(32))[np.repeat(starts[some] - before, size) + np.arange(size.sum())]
                spaced[before + size - 1] = 32
                parts.append((some, *self._plain(spaced.tobytes().decode("ascii"), len(some))))
        rest = np.flatnonzero(~plain)
        if len(rest):
            text = data.tobytes()
            parts.append((rest, *self._one_by_one([text[i:j].decode() for i, j in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])))
        begin, sizes, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), self.n
        for some, ids, size in parts:
            while n + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.ids[n : n + len(ids)] = ids
            begin[some], sizes[some] = n + np.cumsum(size) - size, size
            n += len(ids)
        if len(self.known[0][0]) + len(self.known[1][0]) + len(hashes) <= self.most:
            self.n = n  # else the next new pieces overwrite these
            late = [np.concatenate(x) for x in zip(self.known[1], (hashes, begin, sizes), strict=True)]
            if 8 * len(late[0]) > len(self.known[0][0]):
                late = [np.concatenate(x) for x in zip(self.known[0], late, strict=True)]
                self.known[0] = self._sorted(late)
                late = [x[:0] for x in late]
            self.known[1] = self._sorted(late)
        return begin, sizes

    @staticmethod
    def _sorted(columns: list[np.ndarray]) -> tuple:
        order = np.argsort(columns[0])
        return tuple(x[order] for x in columns)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text) of UTF-8 bytes."""
        data, cut = np.insert(data, offsets[1:-1], 32), offsets[:-1] + np.arange(len(offsets) - 1)  # texts are set apart
        if b"<|" not in data.tobytes():  # no added token
            data = _LOWER[data]
            letter, mark = _LETTER[data], _MARK[data]
            meet = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
            cut = cut + np.searchsorted(meet, cut)
            data = np.insert(data, meet, 32)
        words, starts, ends = word_spans(data)
        pieces, which = np.unique(words, return_inverse=True)
        begin, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        new = np.ones(len(pieces), bool)
        for hashes, at, n in self.known:
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, pieces), len(hashes) - 1)
                hit = hashes[place] == pieces
                begin[hit], sizes[hit] = at[place[hit]], n[place[hit]]
                new &= ~hit
        if new.any():
            example = np.zeros(len(pieces), np.int64)
            example[which] = np.arange(len(words))
            example = example[new]
            begin[new], sizes[new] = self._learn(data, pieces[new], starts[example], ends[example])
        size = sizes[which]
        upto = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(begin[which] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(np.append(upto[np.searchsorted(starts, cut)], upto[-1]))

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts in ascending order of their ids and write them as a table of blocks in the shared folder; returns it.

    A row is a block: part and block give its place, doc_ids and n_tokens the documents in it (each with END_ID at its end),
    payload the coded ids. A null text is an empty one; null ids come first, rows of one id stay side by side. ``path``:
    a tokenizers file whose pre-tokens never hold white space, at the same place on every worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, number = word_encoder(path), TaskContext.get().partitionId(), 0
        blocks: list[tuple[list, list[np.ndarray]]] = [([], [])]
        open_ids = 0

        def flush() -> pa.RecordBatch:
            full = [b for b in blocks if b[0]]
            payloads = encode_blocks([np.concatenate(x) for _, x in full], max(encoder.vocabulary, END_ID + 1))
            columns = [
                pa.array([part] * len(full), pa.int32()),
                pa.array(range(number, number + len(full)), pa.int32()),
                pa.array([ids for ids, _ in full], pa.list_(id_type)),
                pa.array([[len(t) for t in x] for _, x in full], pa.list_(pa.int64())),
                pa.array([sum(map(len, x)) for _, x in full], pa.int64()),
                pa.array(payloads, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_ids", "n_tokens", "n_ids", "payload"])

        for batch in slices(batches):
            id_type = batch.column(0).type
            data, offsets = text_buffer(batch.column(1))
            ids, sizes = [], []
            for a, b in chunks(batch, offsets):
                found = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids.append(np.insert(found[0], np.cumsum(found[1]), END_ID))
                sizes.append(found[1] + 1)
            sizes = np.concatenate(sizes)
            for doc_id, tokens in zip(batch.column(0).to_pylist(), np.split(np.concatenate(ids), np.cumsum(sizes)[:-1]), strict=True):
                blocks[-1][0].append(doc_id)
                blocks[-1][1].append(tokens)
                open_ids += len(tokens)
                if open_ids >= BLOCK_IDS:
                    if len(blocks) == TOGETHER:
                        yield flush()
                        number, blocks = number + len(blocks), []
                    blocks.append(([], []))
                    open_ids = 0
        if blocks[0][0]:
            yield flush()

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return save(ordered.mapInArrow(run, f"part int, block int, doc_ids array<{kind}>, n_tokens array<long>, n_ids long, payload binary"), "tokens")


def read_tokens(blocks: DataFrame, ids: bool = True) -> DataFrame:
    """The documents of a table of blocks: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked, ids.

    start counts in the order of the table: part, block, place in the block. Damaged blocks are errors.
    """
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for a in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(a, TOGETHER)
                out: list[list] = [[] for _ in range(7)]
                for place, sizes, found in zip(range(some.num_rows), some.column(3).to_pylist(), decode_blocks(some.column(4).to_pylist()), strict=True):
                    ends = np.cumsum(sizes)
                    parts = [x.astype("<u4").tobytes() for x in np.split(found, ends[:-1])]
                    for column, values in zip(out, ([some.column(0)[place].as_py()] * len(sizes), [some.column(1)[place].as_py()] * len(sizes), some.column(2)[place].as_py(), (ends - sizes).tolist(), sizes, [zlib.crc32(p) for p in parts], parts if ids else []), strict=True):
                        column += values
                types = [pa.int32(), pa.int32(), batch.column(2).type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)][: 7 if ids else 6], names=names)

    names = ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][: 7 if ids else 6]
    schema = f"part int, block int, doc_id {kind}, within long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    decoded = blocks.select("part", "block", "doc_ids", "n_tokens", "payload").mapInArrow(run, schema)
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("before")).alias("block_start"))
    return decoded.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))

"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The library merges one pair at a time: the adjacent pair whose joined piece has the best score, the leftmost of equals.
Here all words of a batch lie in one flat array of symbols. A round finds the least pair rank of every word (a segmented
minimum), merges all leftmost occurrences of it in all words at once, and closes the gaps; words without a pair that
can merge leave. Rounds go on until no word is left.

Two things keep this equal to the library's order:

* Text is cut into words before a space and then between any two characters that stand side by side in no piece, so
  nothing can ever merge over a cut.
* Merging all occurrences of a rank at once is the same as one after another unless a pair that arises in between
  ranks no higher. Such a pair is looked for in every round; a word that shows one, and a word of more than ``LONG``
  symbols (which would be scanned once for each rank it holds), is finished one merge at a time with a heap.

Characters that no piece holds become their UTF-8 bytes, each an id of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

#: Distinct words whose ids a worker remembers, the first it meets, each of up to so many characters; others are encoded each time.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: Symbols of a word up to which rounds are taken.
LONG = 512
#: Characters of text that are encoded together. One longer text is taken alone.
TOGETHER = 1 << 19
SPACE = "▁"
#: Rank where a pair has no piece.
NONE = np.int64(1 << 40)
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protobuf message; 32-bit values come as their four bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, kind) by id, and whether a text gets a space in front. Only BPE models with byte pieces, and without
    changes to the text but that space, are taken: others raise ValueError."""
    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    pieces = []
    for number, value in model:
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0]), piece.get(3, NORMAL)))
    trainer = dict(_fields(next(v for n, v in model if n == 2)))
    normaliser = dict(_fields(next((v for n, v in model if n == 3), b"")))
    if trainer.get(3, 1) != 2 or trainer.get(24, 0) or normaliser.get(2, b"") or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("not a BPE model that leaves text as it is")
    if {k for *_, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE} or sum(k == BYTE for *_, k in pieces) != 256:
        raise ValueError("a model has to have byte pieces, and none of user-defined or unused kind")
    return pieces, bool(normaliser.get(3, 1))


class Lookup:
    """Values of integer keys of 0 or more in a table of open addressing: -1 for keys that it does not hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -2, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):  # of keys that want one slot the first gets it, the others take the next
            free = left[self.keys[slot[left]] == -2]
            got, one = np.unique(slot[free], return_index=True)
            self.keys[got], self.values[got] = keys[free[one]], values[free[one]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -2)]
        return out


class PieceModel:
    """The symbols, pairs and ranks of a model as arrays."""

    def __init__(self, path: str):
        self.pieces, self.prefix = read_model(path)
        normal = [i for i, p in enumerate(self.pieces) if p[2] == NORMAL]
        texts = {self.pieces[i][0]: i for i in normal}
        self.control = {i for i, p in enumerate(self.pieces) if p[2] == CONTROL}
        self.end = next(i for i, p in enumerate(self.pieces) if p[2] == CONTROL and p[0] == "</s>")
        loose = sorted({c for t in texts for c in t} - set(texts))  # characters of pieces that are none themselves
        symbol = {t: n for n, t in enumerate([*texts, *loose])}
        self.size = len(symbol)
        #: Symbols from ``size`` on are characters that no piece holds: the code point plus ``size``.
        self.ids = np.array([texts.get(t, -1) for t in symbol], np.int64)
        self.code = np.array([ord(t) if len(t) == 1 else 0 for t in symbol], np.int64)
        scores = np.array([self.pieces[texts[t]][1] if t in texts else -np.inf for t in symbol])
        #: Equal scores share a rank. The last one is for no symbol (-1).
        self.rank = np.append(np.searchsorted(np.unique(-scores), -scores), NONE).astype(np.int64)
        self.of_code = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        for t, n in symbol.items():
            if len(t) == 1:
                self.of_code[ord(t)] = n
        pairs = {}
        for t in texts:
            for k in range(1, len(t)):
                if t[:k] in symbol and t[k:] in symbol:
                    pairs[symbol[t[:k]] * self.size + symbol[t[k:]]] = symbol[t]
        self.pairs = pairs
        self.joined = Lookup(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        side = np.array(sorted({symbol[t[k]] * self.size + symbol[t[k + 1]] for t in texts for k in range(len(t) - 1)}), np.int64)
        self.beside = Lookup(side, np.zeros(len(side), np.int64))
        self.byte_ids = np.zeros(256, np.int64)
        for i, (t, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(_BYTE_PIECE.fullmatch(t)[1], 16)] = i
        self.bytes = [b"" if k == CONTROL else bytes([int(_BYTE_PIECE.fullmatch(t)[1], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, _, k in self.pieces]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        cut = not any(a != SPACE and b == SPACE for t in texts for a, b in zip(t, t[1:], strict=False))
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cut else "(?s).+").findall
        self.memory: dict[str, bytes] = {}

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(joined symbol, rank) of each pair; NONE where the two make no piece."""
        joined = self.joined(np.where(np.maximum(a, b) < self.size, a * self.size + b, -1))
        return joined, self.rank[joined]

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """The library's own order: best pair first, leftmost of equals, until none can merge."""
        n = len(symbols)
        symbols, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        joined, rank = self.pair(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(int(r), i, symbols[i], symbols[i + 1], int(j)) for i, (j, r) in enumerate(zip(joined, rank, strict=True)) if j >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, j = heapq.heappop(heap)
            k = right[i]
            if symbols[i] != a or k < 0 or symbols[k] != b:
                continue
            symbols[i], symbols[k], right[i] = j, -1, right[k]
            if right[k] >= 0:
                left[right[k]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and symbols[x] < self.size and symbols[y] < self.size:
                    z = self.pairs.get(symbols[x] * self.size + symbols[y], -1)
                    if z >= 0:
                        heapq.heappush(heap, (int(self.rank[z]), x, symbols[x], symbols[y], z))
        return [s for s in symbols if s >= 0]

    def rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, in order, and the word of each. ``word`` does not fall; nothing merges over its changes."""
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def finish(some: np.ndarray) -> None:
            if len(some):
                edge = np.flatnonzero(np.diff(word[some], prepend=-1))
                for part in np.split(some, edge[1:]):
                    out = np.array(self.one_by_one(symbols[part].tolist()), np.int64)
                    done.append((out, np.full(len(out), word[part[0]])))

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of the symbols at ``at`` with those that follow."""
            after = np.minimum(at + 1, len(symbols) - 1)
            joined, rank = self.pair(symbols[at], symbols[after])
            apart = (word[at] != word[after]) | (after == at)
            return joined, np.where(apart, NONE, rank)

        size = np.bincount(word)[word] if len(word) else word
        finish(np.flatnonzero(size > LONG))
        symbols, word = symbols[size <= LONG], word[size <= LONG]
        joined, rank = pairs(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            index = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            over = (least == NONE)[index]
            if over.any():
                done.append((symbols[over], word[over]))
                symbols, word, joined, rank = symbols[~over], word[~over], joined[~over], rank[~over]
                continue
            at = np.flatnonzero(rank == least[index])
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of occurrences that overlap, every second one from the left
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            before = symbols
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            old_word = word
            symbols = symbols.copy()
            symbols[at] = joined[at]
            limit = least[index[at]]
            # where two merges touch, the pair of the first result and what begins the second stood there in between
            touching = np.flatnonzero(np.diff(at, append=-9) == 2)
            touching = touching[old_word[at[touching]] == old_word[at[touching] + 2]]
            between = self.pair(symbols[at[touching]], before[at[touching] + 2])[1] <= limit[touching]
            symbols, word, joined, rank = symbols[keep], word[keep], joined[keep], rank[keep]
            now = place[at]
            touched = np.zeros(len(symbols), bool)
            touched[now] = touched[np.maximum(now - 1, 0)] = True
            changed = np.flatnonzero(touched)
            joined[changed], rank[changed] = pairs(changed)
            least_of = np.full(int(old_word[-1]) + 1, -1, np.int64)
            least_of[old_word[starts]] = least
            odd = np.unique(np.concatenate((old_word[at[touching][between]], word[changed][rank[changed] <= least_of[word[changed]]])))
            if len(odd):
                fresh = (symbols, word, joined, rank)
                symbols, word = before, old_word
                finish(np.flatnonzero(np.isin(old_word, odd)))
                stay = ~np.isin(fresh[1], odd)
                symbols, word, joined, rank = (x[stay] for x in fresh)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.of_code[code].astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        edge = np.zeros(len(code) + 1, bool)
        edge[np.cumsum(sizes)] = True
        known = (symbols[:-1] < self.size) & (symbols[1:] < self.size)
        key = np.where(known, symbols[:-1] * self.size + symbols[1:], -1)
        cut = edge[:-1].copy()
        cut[1:] |= self.beside(key) < 0
        segment = np.cumsum(cut)
        segment -= segment[0]
        word_of = np.repeat(np.arange(len(words)), sizes)[np.concatenate(([0], np.flatnonzero(np.diff(segment)) + 1))]
        symbols, segment = self.rounds(symbols, segment)
        owner = word_of[segment]
        plain = symbols < self.size
        ids = np.where(plain, self.ids[np.where(plain, symbols, 0)], -1)
        code = np.where(plain, self.code[np.where(plain, symbols, 0)], symbols - self.size)
        # one column for each id that a symbol may give: its own, or up to four bytes
        columns = np.full((len(symbols), 4), -1, np.int64)
        columns[:, 0] = ids
        for low, high, first, size in ((0, 0x80, 0, 1), (0x80, 0x800, 0xC0, 2), (0x800, 0x10000, 0xE0, 3), (0x10000, 0x110000, 0xF0, 4)):
            some = np.flatnonzero((ids < 0) & (code >= low) & (code < high))
            for k in range(size):
                shifted = code[some] >> (6 * (size - 1 - k))
                columns[some, k] = self.byte_ids[shifted | first if k == 0 else shifted & 0x3F | 0x80]
        used = columns >= 0
        flat = columns[used].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, weights=used.sum(axis=1), minlength=len(words))).astype(np.int64)
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian unsigned 32-bit integers. An empty text has the end id only."""
        end = np.array([self.end], "<u4").tobytes()
        split = [self.words(((SPACE if self.prefix else "") + t).replace(" ", SPACE)) if t else [] for t in texts]
        memory = self.memory
        new = list(set().union(*split).difference(memory))
        room = REMEMBERED - len(memory)
        if new:
            memory.update(zip(new, self.encode_words(new), strict=True))
        out = [b"".join([*map(memory.__getitem__, words), end]) for words in split]
        for w in [w for w in new if len(w) > REMEMBERED_LENGTH] if room >= len(new) else new[max(0, room) :]:
            del memory[w]
        return out

    def decode(self, packed: bytes) -> str:
        """The text of ids: control ids are nothing and end a run of byte ids, bytes that are no UTF-8 become U+FFFD each, the
        space in front goes."""
        ids = memoryview(packed).cast("I").tolist()
        while ids and ids[-1] in self.control:
            ids.pop()
        runs: list[list[int]] = [ids]
        if not self.control.isdisjoint(ids):
            runs = [[]]
            for i in ids:
                runs.append([]) if i in self.control else runs[-1].append(i)
        parts = [[self.bytes[i] for i in run] for run in runs]
        first = next((n for n, run in enumerate(runs) if run), None)
        if self.prefix and first is not None and self.pieces[runs[first][0]][0].startswith(SPACE):
            parts[first][0] = parts[first][0][1:]
        return "".join([b"".join(p).decode(errors=_EACH_BYTE) for p in parts])


_EACH_BYTE = "siftwell-each-byte"


def _register() -> None:
    import codecs

    codecs.register_error(_EACH_BYTE, lambda e: ("�" * (e.end - e.start), e.end))


_register()


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in lists of up to ``TOGETHER`` characters, or of one text."""
    some: list[str] = []
    n = 0
    for t in texts:
        if some and n + len(t) > TOGETHER:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens (with the end id) and ids (binary, little-endian unsigned 32-bit integers),
    or with ``digests`` the SHA-256 of the decimal ids joined by one space and of the decoded text.

    A null or empty text has the end id only. Repeated rows and ids are encoded each. No shuffle. ``path``: the model file, at
    the same place on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in slices(batches):
            n, extra, decoded = [], [], []
            for texts in groups([t or "" for t in batch.column(1).to_pylist()]):
                for packed in model.encode(texts):
                    n.append(len(packed) // 4)
                    if digests:
                        extra.append(hashlib.sha256(" ".join([model.decimal[i] for i in memoryview(packed).cast("I")]).encode()).hexdigest())
                        decoded.append(hashlib.sha256(model.decode(packed).encode()).hexdigest())
                    else:
                        extra.append(packed)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(extra, pa.string() if digests else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(decoded, pa.string())] if digests else []), names=names)
            release()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids"]
    kinds = {"doc_id": docs.schema[id_col].dataType.simpleString(), "n_tokens": "long", "ids": "binary"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids): doc_id and text. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in slices(batches):
            texts = [model.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")

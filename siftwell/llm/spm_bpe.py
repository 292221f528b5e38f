"""Byte-level BPE through a sentencepiece model that is serialised from the rank file.

Each byte is mapped to a printable character, each vocabulary entry to a piece of such characters with score -rank, and
the normaliser leaves text as it is; the merges of highest score first are then those of lowest rank first. A piece's id
is its rank. Text is cut into pre-tokens, each encoded by itself (a pre-token that is an entry is that entry), and
decoding maps each id back to its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

#: Distinct chunks that a task remembers, the first it meets; the rest are encoded each time.
REMEMBERED = 800_000
#: White space as Unicode has it; Python's own class also holds U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"


#: White space at either end of a text, or next to other white space.
_LOOSE = re.compile(rf"[{_SPACE}][{_SPACE}]|\A[{_SPACE}]|[{_SPACE}]\Z")


@lru_cache(1)
def pre_token_pattern() -> re.Pattern:
    r"""The pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ in terms of Python's classes.

    Numbers that are not decimal digits (such as superscripts) count as word characters in Python but not as its digits,
    so they are listed, as ranges, from the Unicode data.
    """
    other = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")]
    spans: list[list[int]] = []
    for c in other:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    n = "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)
    letter, number, rest = rf"[^\W\d_{n}]", rf"[\d{n}]", rf"(?:[^{_SPACE}\w]|_)"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{rest}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank. Ranks must be 0, 1, 2 .. without a gap."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: length-delimited for bytes, a varint for int, 32 bits for float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: type BPE, identity normalisation, no dummy prefix, piece id = rank, unknown last."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in entry).encode()) + _field(2, float(-rank)) for rank, entry in enumerate(entries)]
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in [*pieces, unknown]) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes whole texts; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import sentencepiece

        self.entries = read_ranks(path)
        self.whole = {entry: struct.pack("<I", rank) for rank, entry in enumerate(self.entries)}
        self.table = dict(enumerate(byte_characters()))  # Latin-1 character of a byte -> its printable character
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.entries))
        self.memory: dict[str, bytes] = {}
        self.find = pre_token_pattern().findall

    def _tokens(self, tokens: list[str]) -> bytes:
        out = []
        for t in tokens:
            raw = t.encode()
            packed = self.whole.get(raw)
            if packed is None:
                ids = self.model.encode(raw.decode("latin-1").translate(self.table))
                packed = struct.pack(f"<{len(ids)}I", *ids)
            out.append(packed)
        return b"".join(out)

    def _chunk(self, piece: str) -> bytes:
        packed = self._tokens(self.find(piece if piece[0] == "\n" else f" {piece}"))
        if len(self.memory) < REMEMBERED:
            self.memory[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """White space that stands alone begins a chunk that no pre-token crosses, and such chunks are remembered: a
        piece stands for itself after a space, or starts with its line break. Other texts are cut as a whole."""
        if not text or _LOOSE.search(text):
            return self._tokens(self.find(text))
        first, *pieces = text.replace("\n", " \n").split(" ")
        out = [self._tokens(self.find(first))]
        remembered = self.memory.get
        out += [remembered(p) or self._chunk(p) for p in pieces]
        return b"".join(out)

    def forget(self) -> None:
        """Give the memory of remembered chunks back: workers live on after a task, and other steps need it."""
        self.memory = {}
        release()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, memoryview(packed).cast("I")))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and ids (binary), or with ``digests`` the two SHA-256 instead of ids.

    decoded_sha256 is of the bytes that decoding the ids gives. A null or empty text has no ids. ``path``: the rank file,
    at the same place on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        try:
            for batch in slices(batches):
                ids, n, extra, decoded = batch.column(0), [], [], []
                for text in batch.column(1).to_pylist():
                    packed = bpe.encode(text or "")
                    n.append(len(packed) // 4)
                    extra.append(hashlib.sha256(packed).hexdigest() if digests else packed)
                    if digests:
                        decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
                columns = [ids, pa.array(n, pa.int64()), pa.array(extra, pa.string() if digests else pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(decoded, pa.string())] if digests else []), names=names)
        finally:
            bpe.forget()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids"]
    kinds = {"doc_id": docs.schema[id_col].dataType.simpleString(), "n_tokens": "long", "ids": "binary"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids): doc_id and text. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in slices(batches):
            texts = [bpe.decode(x or b"").decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")

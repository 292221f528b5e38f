"""Token counts of a document's sections, from one encoding of the whole document.

The document is encoded once; each token covers a span of characters, and an interval join of these spans with the
sections gives each section its tokens. The rule for a token that crosses a boundary: it belongs to the section that
holds most of its characters, to the earlier one if two hold as many. Characters outside all sections form a section of
their own for this rule, counted as ``outside``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .spm_bpe import read_ranks


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    entries = read_ranks(path)
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={e: i for i, e in enumerate(entries)}, special_tokens={})
    return enc, np.array([len(e) for e in entries], dtype=np.int64)


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, and the first and the past-the-last character of each. A character of several tokens is in the span of each."""
    enc, lengths = encoding(path, pattern)
    ids = enc.encode_to_numpy(text, disallowed_special=())
    if not len(ids):
        return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(lengths[ids])
    if ends[-1] == len(text):  # ASCII
        return ids, np.append(0, ends[:-1]), ends
    char = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
    return ids, char[np.append(0, ends[:-1])], char[ends - 1] + 1


def line_bounds(text: str) -> np.ndarray:
    """Start of each line; a line holds its line break. A text that ends with one has no empty line after it."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    after = np.flatnonzero(codes == 10) + 1
    return np.append(0, after[after < len(codes)])


def in_order(starts: list, ends: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections clipped to the text, in order and apart, and the place of each in the list given. One with a null bound or that ends
    before it starts is empty; of sections that overlap, the one that starts first has the characters of both, of equal starts the first given."""
    s = np.array([length if x is None or y is None else x for x, y in zip(starts, ends, strict=True)], dtype=np.int64).clip(0, length)
    e = np.array([length if x is None or y is None else y for x, y in zip(starts, ends, strict=True)], dtype=np.int64).clip(0, length)
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum(s, e)[order]
    if len(s) > 1:
        taken = np.maximum.accumulate(e)
        s[1:] = np.maximum(s[1:], taken[:-1])
        e = np.maximum(s, e)
    return s, e, order


def allocate(first: np.ndarray, past: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(tokens of each section, tokens outside all, tokens that cross a boundary). Sections are in order and apart."""
    cuts = np.unique(np.concatenate((starts, ends)))  # pieces between cuts are wholly in one section or outside
    piece = np.searchsorted(cuts, first, side="right")
    last = np.searchsorted(cuts, past - 1, side="right")
    crossing = np.flatnonzero(piece != last)
    for t in crossing:
        edges = np.concatenate(([first[t]], cuts[piece[t] : last[t]], [past[t]]))
        piece[t] += int(np.argmax(np.diff(edges)))
    section = np.full(len(cuts) + 1, len(starts), dtype=np.int64)  # section of each piece; len(starts): outside
    begin = np.searchsorted(cuts, starts, side="right")
    full = ends > starts
    section[begin[full]] = np.flatnonzero(full)
    counts = np.bincount(section[piece], minlength=len(starts) + 1)
    return counts[:-1], int(counts[-1]), len(crossing)


def attribute_tokens(docs: DataFrame, path: str, pattern: str, sections_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_sections, n_crossing, n_outside, section_tokens array<int>.

    sections_col: array<struct<start int, end int>> of character ranges, clipped to the text; without it, the lines. Those with a
    null bound or without characters count 0; characters of two sections belong to the one that starts first (see ``in_order``). A
    null or empty text has no tokens and no lines; given sections then count 0 each. A null array is an empty one. ``path`` and ``pattern``: rank file, at the same place on every worker, and pre-token pattern.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        columns += [F.transform(sections_col, lambda x: x["start"]).alias("starts"), F.transform(sections_col, lambda x: x["end"]).alias("ends")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) if sections_col else None
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                text = text or ""
                ids, first, past = token_spans(text, path, pattern)
                if given is None:
                    starts = line_bounds(text)
                    ends = np.append(starts[1:], len(text)) if len(starts) else starts
                    order = None
                else:
                    s, e = next(given)
                    starts, ends, order = in_order(s or [], e or [], len(text))
                counts, outside, crossing = allocate(first, past, starts, ends)
                if order is not None:
                    given_order = np.zeros_like(counts)
                    given_order[order] = counts
                    counts = given_order
                for column, value in zip(out, (len(ids), len(starts), crossing, outside, counts), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:4]], pa.array(out[4], pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, n_outside long, section_tokens array<int>")

"""Many patterns over many texts: one scan for the literals that the patterns need, then only those patterns that may match.

Every alternative of a pattern holds a run of plain characters without which it cannot match. An Aho-Corasick automaton looks for
all those runs at once, so the time a text takes hardly depends on the number of patterns. An alternative that is nothing but such
a run has matched with it; of the others only those whose run was seen are tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # runs are then looked for one by one
    ahocorasick = None

#: Characters with a meaning of their own in a pattern.
_META = set(".^$*+?{}[]()|")


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at those bars that stand in no group and no class."""
    out, depth, in_class, at = [""], 0, False, 0
    while at < len(pattern):
        c = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        in_class = c == "[" or in_class and c != "]"
        depth += (c == "(") - (c == ")") if not in_class else 0
        if c == "|" and not depth and not in_class:
            out.append("")
        else:
            out[-1] += c
        at += len(c)
    return out


def literal(pattern: str) -> tuple[str, bool]:
    """(longest run of characters that every match holds, in small letters; whether the pattern is that run). Groups and classes
    are passed over, and a character that may be absent ends a run."""
    runs, at, whole = [""], 0, True
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            runs[-1] += pattern[at + 1]
            at += 2
        elif c in _META or c == "\\":
            whole = False
            if c in "*?{":
                runs[-1] = runs[-1][:-1]
            if c in "[({":
                end, depth = at + 1, 1
                while depth and end < len(pattern):
                    step = 2 if pattern[end] == "\\" else 1
                    depth += (pattern[end] == c) - (pattern[end] == {"[": "]", "(": ")", "{": "}"}[c])
                    end += step
                at = end
            else:
                at += 2 if c == "\\" else 1
            runs.append("")
        else:
            runs[-1] += c
            at += 1
    return max(runs, key=len).lower(), whole


class Patterns:
    """Tells which of a list of patterns match a text; capital and small ASCII letters are alike."""

    def __init__(self, patterns: Sequence[str]):
        self.always: list[tuple[int, re.Pattern]] = []
        needed: dict[str, list[tuple[int, re.Pattern | None]]] = {}
        for number, pattern in enumerate(patterns):
            for one in alternatives(pattern):
                run, whole = literal(one)
                test = None if whole else re.compile(one, re.I | re.A)
                if run:
                    needed.setdefault(run, []).append((number, test))
                else:
                    self.always.append((number, test))
        self.needed = needed
        self.automaton = None
        if ahocorasick is not None and needed:
            self.automaton = ahocorasick.Automaton()
            for run in needed:
                self.automaton.add_word(run, run)
            self.automaton.make_automaton()

    def _seen(self, text: str) -> set[str]:
        low = text.lower() if text.isascii() else text.encode(errors="surrogatepass").lower().decode(errors="surrogatepass")
        if self.automaton is None:
            return {run for run in self.needed if run in low}
        return {run for _, run in self.automaton.iter(low)}

    def match(self, text: str | None) -> list[int]:
        """Numbers of the patterns that match, ascending. A null or empty text matches none."""
        if not text:
            return []
        out = {number for number, test in self.always if test is None or test.search(text)}
        for run in self._seen(text):
            for number, test in self.needed[run]:
                if number not in out and (test is None or test.search(text)):
                    out.add(number)
        return sorted(out)


@lru_cache(8)
def _patterns(patterns: tuple[str, ...]) -> Patterns:
    return Patterns(patterns)


def matching(text: Column, patterns: Sequence[str]) -> Column:
    """array<int>: the numbers (from 0) of the patterns that match somewhere in the text, ascending. Arrow batches."""
    own = tuple(patterns)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = _patterns(own).match
        for texts in batches:
            yield texts.map(match)

    return run(text)

"""Shared plumbing of the text scanners: cue search over whole texts, line bookkeeping, span replacement."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick


def build(cues: dict[str, str]) -> ahocorasick.Automaton:
    """Aho-Corasick automaton: lower-case cue -> kind."""
    a = ahocorasick.Automaton()
    for cue, kind in cues.items():
        old = a.get(cue, frozenset())
        a.add_word(cue, old | {kind})
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case at unchanged offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def cued_lines(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, int, set[str]]]:
    """(line number from 1, start, end, kinds) of every line with a cue, in order. A line ends at \\n only."""
    starts: list[int] | None = None
    line, kinds = -1, set()
    for end, found in automaton.iter(lowered(text)):
        if starts is None:
            starts = [0]
            at = text.find("\n")
            while at >= 0:
                starts.append(at + 1)
                at = text.find("\n", at + 1)
        at = bisect_right(starts, end) - 1
        if at != line:
            if kinds:
                yield line + 1, starts[line], _line_end(text, starts, line), kinds
            line, kinds = at, set()
        kinds |= found
    if kinds:
        yield line + 1, starts[line], _line_end(text, starts, line), kinds


def _line_end(text: str, starts: list[int], line: int) -> int:
    return starts[line + 1] - 1 if line + 1 < len(starts) else len(text)


def replace_spans(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, replacement) put in; of overlapping spans the first wins, then the longest."""
    out, at = [], 0
    for lo, hi, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if lo >= at:
            out += [text[at:lo], new]
            at = hi
    return "".join(out) + text[at:]

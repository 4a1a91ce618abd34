"""Mentions of one dictionary in one text: folded text with its offset map, an automaton with failure links, chosen spans.

Small helpers of the Arrow functions in ``matching``; they see one document at a time.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from functools import cache
from itertools import chain

import numpy as np

from glossmark.functions.text import accent_table

#: (type, type_rank, mention, start, end): offsets are code points of the raw text.
Span = tuple[str, int, str, int, int]


@cache
def _composed() -> dict[int, int]:
    return str.maketrans(*accent_table())


@cache
def _patterns():
    import regex

    return regex.compile(r"\p{Mn}"), regex.compile(r"[\p{L}\p{N}_À-ſ]")


@cache
def _word_table() -> np.ndarray:
    """For each code point whether it belongs to words: 1, 0, or -1 where the pattern wasn't asked yet."""
    return np.full(0x110000, -1, np.int8)


def word_flags(text: str) -> np.ndarray:
    """Which characters belong to words; False before the first and after the last."""
    table, codes = _word_table(), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for code in np.unique(codes[table[codes] < 0]).tolist():
        table[code] = bool(_patterns()[1].match(chr(code)))
    return np.concatenate([[False], table[codes] > 0, [False]])


def folded(text: str) -> tuple[str, list[int] | None]:
    """``text`` without accents and case, and where each of its characters stands in the raw text, with the end as
    the last place (None: every character stands where it stood).

    Composed Latin letters are replaced in place. Where that isn't all, each character gives its canonical base
    without marks, so decomposed accents and marks of other scripts go and the places say what is left.
    """
    if text.isascii():
        return text.lower(), None
    mark, _ = _patterns()
    plain, table = text, _composed()
    for char in set(text):
        base = table.get(ord(char))
        if base is not None:
            plain = plain.replace(char, chr(base))
    if not mark.search(unicodedata.normalize("NFD", plain)):
        low = plain.lower()
        if len(low) == len(text):
            return low, None
    out, places = [], []
    for at, char in enumerate(text):
        base = mark.sub("", unicodedata.normalize("NFD", char)).lower()
        base = mark.sub("", base)
        out.append(base)
        places += [at] * len(base)
    return "".join(out), [*places, len(text)]


class Finder:
    """A dictionary compiled once: (type, type_rank, mention) triples, searched in one pass over a text."""
    def __init__(self, words: list[tuple[str, int, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by_form: dict[str, list[tuple[str, int, str]]] = {}
        for kind, rank, mention in words:
            form = folded(mention)[0]
            if form.strip():
                by_form.setdefault(form, []).append((kind, rank, mention))
        for at, form in enumerate(by_form):
            self.automaton.add_word(form, at)
        if by_form:
            self.automaton.make_automaton()
        self.empty = not by_form
        self.words = [word for same in by_form.values() for word in same]
        self.sizes = np.array([len(form) for form in by_form], np.int64)
        self.counts = np.array([len(same) for same in by_form.values()], np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        numbers: dict[str, int] = {}
        self.mentions = np.array([numbers.setdefault(mention, len(numbers)) for _, _, mention in self.words], np.int64)

    def places(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences that no word character touches on either side, in the order in which they end: which of
        ``words`` it is, start and end."""
        if self.empty or not text:
            return (np.empty(0, np.int64),) * 3
        form, raw = folded(text)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(form)), np.int64).reshape(-1, 2)
        end, which = hits[:, 0] + 1, hits[:, 1]
        start, inside = end - self.sizes[which], word_flags(form)
        alone = ~(inside[start] | inside[end + 1])
        start, end, which = start[alone], end[alone], which[alone]
        if raw is not None:
            raw = np.array(raw, np.int64)
            start, end = raw[start], raw[end]
        times = self.counts[which]
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(self.firsts[which], times) + turn, np.repeat(start, times), np.repeat(end, times)

    def leftmost(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``places`` the leftmost of each mention: those of one mention end in text order."""
        which, start, end = self.places(text)
        first = np.unique(self.mentions[which], return_index=True)[1]
        return which[first], start[first], end[first]

    def spans(self, text: str | None) -> list[Span]:
        """The same as ``places`` as a list of spans."""
        which, start, end = self.places(text)
        return [(*self.words[k], s, e) for k, s, e in zip(which.tolist(), start.tolist(), end.tolist(), strict=True)]

    def first_places(self, text: str | None) -> dict[str, tuple[int, int]]:
        """Start and end of each mention's leftmost occurrence: those of one mention end in text order."""
        places: dict[str, tuple[int, int]] = {}
        for _, _, mention, start, end in self.spans(text):
            places.setdefault(mention, (start, end))
        return places


class Chooser:
    """Takes spans offered in priority order unless a taken one touches them.

    Taken spans don't overlap, so of them in text order only the last that starts before a span's end can touch it. A
    mention's own occurrences are read from left to right: one that starts inside the one read last is passed over.
    """
    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.mention, self.read_to = None, 0

    def takes(self, rank: int, mention: str, start: int, end: int) -> bool:
        if (rank, mention) != self.mention:
            self.mention, self.read_to = (rank, mention), 0
        if start < self.read_to:
            return False
        self.read_to = end
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def priority(span: Span) -> tuple:
    """Lower type ranks first, then longer mentions, then text order."""
    kind, rank, mention, start, end = span[:5]
    return rank, -len(mention), mention, start, end, kind


def chosen(spans: list[Span]) -> list[Span]:
    """The spans that stay, in text order."""
    chooser = Chooser()
    return sorted((s for s in sorted(spans, key=priority) if chooser.takes(*s[1:5])), key=lambda s: s[3])

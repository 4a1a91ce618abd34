"""Tokens by word rules: exceptions, prefixes, suffixes and infixes.

A text is cut at white space. From each piece signs are taken off the front and the back, one at a time, until what is
left is an exception or has no more of them; then it is cut at infixes. Rules see one word only, so each distinct word
of some hundred thousand is cut once, inside the documents' rows: no word is shuffled and a frequent word is no hot key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glossmark.operators.tokens import MARK, bio_tokens, edges_of, row_slices, without_marks

# Fixed values of Spanish: abbreviations that keep their dots, contractions with their parts, units after a number.
ABBREVIATIONS = (
    "Sr.", "Sra.", "Srta.", "Dr.", "Dra.", "D.", "Dña.", "Prof.", "Ud.", "Uds.", "Vd.", "Vds.",
    "aprox.", "etc.", "p.ej.", "pág.", "págs.", "núm.", "máx.", "mín.", "ref.", "tel.", "vol.", "vs.", "cap.", "art.",
    "EE.UU.", "a.C.", "d.C.", "a.m.", "p.m.", "c.c.", "i.v.", "i.m.", "s.c.", "v.o.",
)
CONTRACTIONS = {"pal": ("pa", "l"), "pala": ("pa", "la"), "d'": ("d'",), "l'": ("l'",), "pa'": ("pa'",)}
UNITS = (
    "kg", "mg", "µg", "mcg", "ng", "g", "km", "cm", "mm", "µm", "nm", "m", "ml", "dl", "cl", "µl", "l", "mmol", "mol",
    "mEq", "UI", "kcal", "mmHg", "Hz", "°C", "°F", "h", "min", "s", "ms",
)
#: Signs that stand off at the front or the back of a word, the percent sign at the front only.
SIGNS = r"¿¡!?.,;:()\[\]{}<>\"'«»“”‘’…§=€$£|—–"


@dataclass(frozen=True)
class WordRules:
    """Exceptions (word to its parts) and the patterns of one language.

    ``prefix`` and ``suffix`` match what comes off, ``infix`` a separator, ``gap`` a place between two letters. A word of
    letters alone is cut by exceptions only.
    """
    exceptions: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    initial: str = r"\p{L}\."
    prefix: str = rf"\.{{2,}}|[{SIGNS}%]|\+(?![0-9])"
    suffix: str = rf"\.{{2,}}|[{SIGNS}]|['’]s|(?<=[0-9])(?:{'|'.join(UNITS)}|\+)"
    infix: str = r"\.{2,}|…|--+|(?<=\p{L}),(?=\p{L})|(?<=[\p{L}0-9])[:<>=/](?=\p{L})|(?<=[0-9])[+*^](?=[0-9-])"
    gap: str = r"(?<=\p{Ll})(?=\.\p{Lu})|(?<=\p{Ll}\.)(?=\p{Lu})"

    def __post_init__(self) -> None:
        for word, parts in self.exceptions.items():
            if "".join(parts) != word or not all(parts) or regex.search(r"\p{White_Space}", word):
                raise ValueError(f"the parts of the exception {word!r} don't make it up")


#: Abbreviations as written and with a first capital, contractions likewise.
SPANISH = WordRules({
    form: tuple(parts)
    for word, own in [*((a, (a,)) for a in ABBREVIATIONS), *CONTRACTIONS.items()]
    for form, parts in ((word, own), (word[0].upper() + word[1:], (own[0][0].upper() + own[0][1:], *own[1:])))
})


class Cutter:
    """Rules compiled for one task; ``parts`` of a word without white space join to the word."""

    def __init__(self, rules: WordRules) -> None:
        self.exceptions, self.known = dict(rules.exceptions), {}
        self.longest = max(map(len, self.exceptions), default=0)
        self.initial = regex.compile(rules.initial)
        self.prefix = regex.compile(rules.prefix)
        self.suffix = regex.compile(rules.suffix)
        self.infix = regex.compile(rf"({rules.infix})|{rules.gap}", regex.V1)

    def parts(self, word: str) -> list[str]:
        if word not in self.known:
            self.known[word] = [word] if word.isalpha() and word not in self.exceptions else self._cut(word)
        return self.known[word]

    def _cut(self, word: str) -> list[str]:
        start, end, back = 0, len(word), []
        front: list[str] = []
        while start < end:
            if end - start <= self.longest and (whole := self.exceptions.get(word[start:end])):
                front += whole
                break
            if self.initial.fullmatch(word, start, end):
                front.append(word[start:end])
                break
            if found := self.prefix.match(word, start, end):
                front.append(found[0])
                start = found.end()
            elif (found := self._last(word, start, end)) is not None:
                back.append(word[found:end])
                end = found
            else:
                front += [p for p in self.infix.split(word[start:end]) if p]
                break
        return front + back[::-1]

    def _last(self, word: str, start: int, end: int) -> int | None:
        """Where the suffix that ends at ``end`` begins; suffixes are short, so only the last places are tried."""
        for at in range(max(start + 1, end - 8), end):
            if self.suffix.fullmatch(word, at, end):
                while word[at] == "." and at > start + 1 and word[at - 1] == ".":
                    at -= 1
                return at
        return None


def word_pieces(text: Column, rules: WordRules = SPANISH) -> Column:
    """The text as an array of tokens, each with the white space before it; the elements join to the text."""

    @F.arrow_udf(ArrayType(StringType()))
    def cut(words: pa.Array) -> pa.Array:
        cutter, space = Cutter(rules), regex.compile(r"\p{White_Space}*")

        def pieces(word):
            bare = space.match(word).end()
            parts = cutter.parts(word[bare:])
            return [word[:bare] + parts[0], *parts[1:]] if parts else [word]

        out = []
        for rows in row_slices(np.diff(edges_of(words))):
            here = words[rows]
            forms = here.flatten().dictionary_encode()
            cuts = pa.array([pieces(w) for w in forms.dictionary.to_pylist()], pa.list_(pa.string())).take(forms.indices)
            edges = edges_of(cuts)[edges_of(here)]
            out.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), cuts.flatten(), mask=here.is_null()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return cut(F.filter(F.split(F.regexp_replace(without_marks(text), r"(?U)(\S+)", "$1" + MARK), MARK), lambda p: p != ""))


def rule_tokens(
    docs: DataFrame, key: str, text: str = "text", *keep: str, rules: WordRules = SPANISH, spans: str | None = None, lists: str | None = None,
) -> DataFrame:
    """As ``bio_tokens``, with tokens by word rules: key, kept columns, idx, token, start, end, sent_idx (and label), or
    one row per text with the column ``lists``.

    Offsets are those of the raw text. The dot of an abbreviation is no sign of its own, so it ends no sentence. A null or
    empty text has no tokens.
    """
    return bio_tokens(docs, key, text, *keep, spans=spans, cut=lambda c: word_pieces(c, rules), lists=lists)

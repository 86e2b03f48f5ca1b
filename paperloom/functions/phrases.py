"""Words and word sequences of any number of lists, looked up in one pass over a text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore of any script make up a word.
WORD = r"[\p{L}\p{N}_]"
_SPACES = re.compile(rb"[ \t\n\x0b\x0c\r]+")


@dataclass(frozen=True)
class Phrase:
    """Words that stand together, any white space between them; whole words, in any case of ASCII letters.

    ``any_ending``: the last word may go on. ``plural``: it may have an s more. ``as_written``: case counts.
    """

    text: str
    any_ending: bool = False
    plural: bool = False
    as_written: bool = False

    def pattern(self) -> str:
        """The same as a regular expression, without its left border."""
        body = r"\s+".join(re.escape(part) for part in self.text.split())
        body = body if self.as_written else f"(?{'i' if self.text.isascii() else 'iu'}:{body})"
        if self.any_ending:
            return f"{body}{WORD}*"
        return f"{body}{'s?' if self.plural else ''}(?!{WORD})"


def pattern_of(phrases: Sequence[Phrase]) -> str:
    """Any of the phrases, the earlier one first, as a regular expression."""
    return rf"(?<!{WORD})(?:{'|'.join(p.pattern() for p in phrases)})"


class PhraseBook:
    """Lists of phrases in one Aho-Corasick automaton."""

    def __init__(self, lists: Sequence[Sequence[Phrase]]):
        import ahocorasick

        self.lists = lists
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list[tuple[int, int, bytes]]] = {}
        for number, phrases in enumerate(lists):
            for order, phrase in enumerate(phrases):
                written = " ".join(phrase.text.split()).encode()
                entries.setdefault(written.lower().decode("latin-1"), []).append((number, order, written))
        for key, found in entries.items():
            self.automaton.add_word(key, (len(key), found))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    @staticmethod
    def _character(data: bytes, at: int) -> int:
        """Size of the word character at a place, or 0 where none begins."""
        if at >= len(data):
            return 0
        first = data[at]
        if first < 0x80:
            return 1 if first == 0x5F or chr(first).isalnum() else 0
        size = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size if unicodedata.category(data[at : at + size].decode("utf-8", "replace")[0])[0] in "LN" else 0

    def _word_before(self, data: bytes, at: int) -> bool:
        at -= 1
        while at > 0 and data[at] & 0xC0 == 0x80:
            at -= 1
        return at >= 0 and self._character(data, at) > 0

    def _end(self, phrase: Phrase, data: bytes, end: int) -> int:
        """Where the match ends; 0 where there is none."""
        if phrase.any_ending:
            while size := self._character(data, end):
                end += size
            return end
        if not self._character(data, end):
            return end
        if phrase.plural and data[end : end + 1] == b"s" and not self._character(data, end + 1):
            return end + 1
        return 0

    def __call__(self, text: str | None) -> list[list[int]]:
        """For each list the phrases found, as numbers in the list, from left to right and without overlaps."""
        out: list[list[int]] = [[] for _ in self.lists]
        if not text or self.empty:
            return out
        data = _SPACES.sub(b" ", text.encode("utf-8", "replace"))  # bytes: lowering changes ASCII letters only
        found: list[tuple[int, int, int, int]] = []
        for last, (size, entries) in self.automaton.iter(data.lower().decode("latin-1")):
            start = last + 1 - size
            if self._word_before(data, start):
                continue
            for number, order, written in entries:
                phrase = self.lists[number][order]
                if phrase.as_written and data[start : last + 1] != written:
                    continue
                if end := self._end(phrase, data, last + 1):
                    found.append((start, number, order, end))
        free = [0] * len(self.lists)
        for start, number, order, end in sorted(found):
            if start >= free[number]:
                out[number].append(order)
                free[number] = end
        return out


_books: dict[tuple, PhraseBook] = {}


def phrases_found(text: Column, lists: Sequence[Sequence[Phrase]]) -> Column:
    """An array for each list: the numbers of its phrases in the text, from left to right and without overlaps.

    Where phrases of a list begin at one place the earlier one of the list counts. One pass over the text
    serves all lists. Lists that are not ``in_the_book`` must
    be searched by their pattern.
    """
    key = tuple(tuple(some) for some in lists)

    @F.pandas_udf("array<array<int>>")
    def look_up(texts: pd.Series) -> pd.Series:
        book = _books.get(key)
        if book is None:
            book = _books[key] = PhraseBook(key)
        return texts.map(book, na_action=None) if len(texts) else pd.Series([], dtype=object)

    return look_up(text)


def in_the_book(phrases: Sequence[Phrase]) -> bool:
    """Whether the automaton can hold the phrases: letters beyond ASCII only where case counts."""
    return all(p.as_written or p.text.isascii() for p in phrases)

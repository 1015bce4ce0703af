"""A text prepared once for all readers: folded lower case, numbers, and small parsers that look beside a place.

Plain Python for use inside one Arrow call. Every parser reads a bounded window or moves forward only, so the time is
linear in the text. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache

from spanveil.functions.text import ALIKE_CYRILLIC, ALIKE_LATIN

_FOLD = str.maketrans(ALIKE_LATIN, ALIKE_CYRILLIC)
_PAIRS = tuple(zip(ALIKE_LATIN, ALIKE_CYRILLIC))
_NO_BLANKS = str.maketrans("", "", " \t ")
_RUN = re.compile(r"\+?[0-9]++(?:[ \t\xa0 \-–—‑./()\\№#]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
LETTERS = re.compile(r"[A-Za-zÀ-ɏḀ-ỿЀ-ԯ]+")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = frozenset("0123456789")


@dataclass(frozen=True, slots=True)
class Run:
    """A number: digit groups glued by up to three separators."""

    start: int
    end: int
    digits: str
    groups: tuple[int, ...]
    seps: str
    plus: bool


@lru_cache(4096)
def folded(words: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Anchors with look-alike letters folded, and the same without blanks."""
    both = tuple(dict.fromkeys(w.translate(_FOLD) for w in words))
    return both, tuple(dict.fromkeys(w.translate(_NO_BLANKS) for w in both))


class Look:
    """One text with what several readers need."""

    __slots__ = ("text", "low", "fold", "__dict__")

    def __init__(self, text: str):
        self.text = text
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.low = low
        for latin, cyrillic in _PAIRS:
            low = low.replace(latin, cyrillic)
        self.fold = low

    @cached_property
    def runs(self) -> list[Run]:
        """Numbers by place. A group right behind a letter stands alone."""
        out, text, pos = [], self.text, 0
        while m := _RUN.search(text, pos):
            start, pos = m.span()
            plus = text[start] == "+"
            if not plus and start and LETTERS.match(text, start - 1):
                pos = _GROUP.match(text, start).end()
            groups = _GROUP.findall(text, start, pos)
            seps = "" if len(groups) == 1 else "".join(sorted(set(text[start + plus : pos]) - _DIGITS))
            out.append(Run(start, pos, "".join(groups), tuple(map(len, groups)), seps, plus))
        return out

    def around(self, start: int, end: int, before: int, after: int) -> str:
        return self.fold[max(0, start - before) : end + after]

    def has(self, start: int, end: int, words: tuple[str, ...], before: int, after: int) -> bool:
        """Whether an anchor stands in the window, the span itself included."""
        return any(map(self.around(start, end, before, after).__contains__, folded(words)[0]))

    def before(self, start: int, words: tuple[str, ...], reach: int) -> bool:
        """Whether the nearest anchor on the left has no digit behind it; blanks inside anchors count only where no anchor
        stands as it is written."""
        left = self.fold[max(0, start - reach) : start]
        plain, squeezed = folded(words)
        best = max((at + len(w) for w in plain if (at := left.rfind(w)) >= 0), default=-1)
        if best >= 0:
            return not _DIGIT.search(left, best)
        compact = left.replace(" ", "").replace("\t", "").replace("\u00a0", "")
        found = [w for w in squeezed if w in compact]
        if not found:
            return False
        longest = max(found, key=len)
        return not _DIGIT.search(compact, compact.rfind(longest) + len(longest))

    def typo(self, start: int, end: int, words: tuple[str, ...], before: int, after: int, least: int = 7) -> bool:
        """Whether a word of the window is an anchor of so many letters but for one edit, or an anchor stands there with
        blanks put in."""
        window = self.around(start, end, before, after)
        if any(len(w) >= least - 1 and _misspelt(w, words, least) for w in LETTERS.findall(window)):
            return True
        return any(map(window.replace(" ", "").replace("\t", "").replace("\u00a0", "").__contains__, _long(words, least)))

    def head(self, start: int, reach: int) -> str:
        """The sentence up to here, of so many code points at most."""
        left = self.low[max(0, start - reach) : start]
        return left[max(map(left.rfind, ".!?;\n\r")) + 1 :]


@lru_cache(4096)
def _long(words: tuple[str, ...], least: int) -> tuple[str, ...]:
    return tuple(w for w in folded(words)[0] if len(w) >= least)


@lru_cache(100_000)
def _misspelt(word: str, words: tuple[str, ...], least: int) -> bool:
    return any(nearly_equal(word, w) for w in _long(words, least))


def nearly_equal(a: str, b: str) -> bool:
    """Equal but for one letter changed, put in or left out, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    more = len(b) - len(a)
    if more > 1:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[n - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    rest = n - i - j
    return rest == 0 if more else rest <= 1 or rest == 2 and a[i] == b[i + 1] and a[i + 1] == b[i]


def any_in(window: str, words: Iterable[str]) -> bool:
    return any(map(window.__contains__, words))


def groups_of(look: Look, run: Run) -> list[tuple[int, int]]:
    """Start and end of each digit group of a number."""
    return [m.span() for m in _GROUP.finditer(look.text, run.start, run.end)]

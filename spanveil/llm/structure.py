"""Text quality statistics of each document, and whether it is running prose, a list, a table or junk.

Method. Words, signs and line structure of a text are counted by class: connecting words, prepositions, verb-like and
other words, words no language makes, repeats, numbers, sentence ends, separators, list marks and so on. A text has a
second, small distribution: whether it has items, columns, labelled values, and whether nothing runs between its items.
Both are compared by Jensen-Shannon divergence with profiles of prose and of other structures (a list has items for sure,
a table columns, a form labels, and in prose something runs); the text gets the profile of the least sum. Which words
no language makes is told from letter pairs: their frequencies are counted over all texts first.

Defined results: NULL and empty texts have zero counts, no structure (NULL) and are not reported. Texts of a single
word are compared like others. Categories are not used. Words with letters of scripts beyond U+0800 are never held for
impossible: their letter pairs are not counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.pii import folded
from spanveil.runtime import spread

# Connecting words, and prepositions and articles, Russian and English.
CONNECT = set(
    """и а но что как это был была было были уже ещё еще ли же бы он она оно они мы вы я не ни так то все всё только там
    тут здесь меня мне мой моя нам вам его её их который которая которое которые которую чем где тоже хотя зато чтобы если
    когда или потом сначала никто ничего теперь нас нельзя можно нужно надо лишь снова опять очень вполне слишком пока
    почему зачем потому поэтому тогда каждый кто кто-то давно сам сама тот та ту да нет есть просим прошу однако затем итоге
    i you we they he she it and but or not no that this which who whom so if then when was were is are be been has have had
    do does did will would can could may might must should nobody someone somebody me my our your his her their them us only
    yet however although because than there here again also once please thanks what how why while""".split()
)
PLACE = set("в во на с со к ко о об от до из за у для по при без из-за через после перед под над между про около the a an of to in on at for from by with as into near after before during about over under near due".split())
VERB = re.compile(r"(?:[аяиыуеё]л[аои]?|л[аои]?сь|лся|[аяуюеё]ет|[ую]ют|[аяи]тся|[её]тся|[ую]тся|[аяи]т|[иы]т|ешь|ишь|айте|ите|йте|ены?|ён|ена|ено|ана|ано|аны|[аяуюиы]ёт|шл[аои]|шёл)$|^[a-z]{3,}(?:ed|ing)$")
#: Endings that few nouns share with verbs.
SURE_VERB = re.compile(r"(?:[аяуюеи][её]т|[её]тся|[аяиую]тся|[аяиыуеё]л[аои]|л[аои]?сь|лся|[ую]ют|ают|яют|айте|ите|йте)$|^[a-z]{3,}(?:ed|ing)$")
CLASSES = ("connect", "place", "verb", "word", "odd", "repeat", "number", "end", "comma", "field", "sep", "mark", "break", "symbol")
# Profiles, in hundredths by CLASSES. The first part of a name is the structure.
PROFILES = {
    "prose running": (20, 13, 12, 34, 1, 1, 4, 8, 5, 1, 0, 0, 1, 0),
    "prose english": (24, 22, 10, 31, 1, 1, 2, 7, 2, 0, 0, 0, 1, 0),
    "prose short": (6, 8, 11, 50, 1, 0, 9, 8, 5, 1, 0, 0, 0, 1),
    "prose unpointed": (21, 15, 14, 44, 2, 1, 3, 0, 0, 0, 0, 0, 0, 0),
    "prose data": (3, 9, 10, 38, 1, 0, 15, 8, 9, 4, 0, 0, 0, 3),
    "prose dialogue": (17, 12, 11, 35, 1, 1, 4, 7, 5, 1, 0, 3, 2, 1),
    "list marked": (0, 4, 1, 40, 1, 0, 7, 5, 0, 0, 4, 20, 18, 0),
    "list plain": (0, 5, 2, 51, 1, 0, 8, 8, 0, 0, 3, 0, 22, 1),
    "list commas": (0, 4, 2, 58, 1, 0, 4, 1, 29, 0, 0, 0, 1, 0),
    "table marks": (0, 3, 1, 27, 0, 0, 26, 1, 1, 0, 32, 0, 9, 0),
    "table commas": (0, 3, 1, 27, 0, 0, 26, 1, 32, 0, 0, 0, 9, 0),
    "fields lines": (0, 3, 1, 43, 0, 1, 12, 3, 1, 18, 0, 0, 15, 3),
    "fields marks": (0, 3, 1, 43, 0, 1, 12, 3, 1, 18, 15, 0, 0, 3),
    "junk words": (0, 3, 1, 8, 82, 1, 1, 2, 1, 0, 0, 0, 1, 0),
    "junk particles": (55, 40, 0, 0, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0),
    "junk repeats": (0, 0, 0, 1, 0, 66, 0, 11, 11, 0, 5, 0, 0, 6),
    "junk signs": (0, 0, 0, 2, 2, 0, 2, 0, 0, 0, 2, 2, 6, 84),
    "junk numbers": (0, 0, 0, 1, 1, 0, 50, 0, 46, 0, 0, 0, 1, 1),
    "junk debris": (0, 0, 0, 4, 6, 26, 15, 0, 0, 12, 6, 0, 3, 28),
}
_TOKEN = re.compile(
    r"(?P<data>[^\s@|;,=:]+@[^\s|;,]+|(?:https?://|www\.)\S+|[^\W\d_]*\d[\w.:/–—-]*\w|\d)"
    r"|(?P<word>[^\W\d_]+(?:[-'’][^\W\d_]+)*)"
    r"|(?P<line>[ \t]*[\r\n]\s*)"
    r"|(?P<end>[.!?…]+(?=\s|$|[»\")]))"
    r"|(?P<comma>,)"
    r"|(?P<field>[:=](?=\s|\S))"
    r"|(?P<sep>[;|]|\t| {3,})"
    r"|(?P<symbol>[^\s])"
)
_MARK = re.compile(r"(?:[-•*·–>—]|\d{1,3}[.)])(?=\s)")
#: Words shorter than this are never held for impossible.
ODD_LETTERS = 4
#: Mean log frequency of a word's letter pairs below which it is impossible.
ODD_BELOW = -4.75
#: The same over all words of a text: below it, the text is made of words that no language makes, even if each alone
#: could pass.
SENSELESS_BELOW, SENSELESS_WORD = -3.3, -2.9
#: Share of all words from which on one word counts as a repeat.
REPEAT_SHARE = 0.3


def pairs_of(word: str) -> Iterator[str]:
    w = f"^{word}$"
    return (w[i : i + 2] for i in range(len(w) - 1))


class Letters:
    """How frequent a letter is after another, from counts of pairs over all texts."""

    def __init__(self, counts: dict[str, int]):
        first: Counter[str] = Counter()
        for p, n in counts.items():
            first[p[0]] += n
        self.log = {p: math.log(n / first[p[0]]) for p, n in counts.items()}
        self.least = -9.0
        self.known: dict[str, float] = {}
        self.kinds: dict[str, tuple[str, bool, float]] = {}

    def kind(self, word: str) -> tuple[str, bool, float]:
        """The class of a word by itself, whether it is a verb for sure, and the mean log frequency of its letter pairs
        (0 for a word that is never held for impossible); kept, as words repeat."""
        verb = bool(VERB.search(word))
        own = "connect" if word in CONNECT else "place" if word in PLACE else "verb" if verb else "word"
        known = own in ("connect", "place") or len(word) < ODD_LETTERS or not judged_word(word)
        got = own, verb and bool(SURE_VERB.search(word)) and own not in ("connect", "place"), 0.0 if known else self.total(word) / (len(word) + 1)
        if len(self.kinds) > 200_000:
            self.kinds.clear()
        self.kinds[word] = got
        return got

    def total(self, word: str) -> float:
        """The log frequencies of a word's letter pairs summed up; words repeat, so sums are kept."""
        got = self.known.get(word)
        if got is None:
            get, least = self.log.get, self.least
            got = sum(max(least, get(p, least)) for p in pairs_of(word))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got
        return got

    def mean(self, words: list[str]) -> float:
        """Mean log frequency of the letter pairs of longer words."""
        long = [w for w in words if len(w) >= ODD_LETTERS and judged_word(w)]
        return sum(map(self.total, long)) / (sum(map(len, long)) + len(long)) if long else 0.0


def judged_word(word: str) -> bool:
    """Whether all letters are of alphabets below U+0800, which bounds the table of letter pairs by their sizes."""
    return word.isascii() or max(word) < "\u0800"


def _case_noise(w: str) -> bool:
    """Capitals inside a word, more than one change: encoded data, not a word."""
    return len(_RISE.findall(w)) >= 2


_RISE = re.compile("[a-zа-яё](?=[A-ZА-ЯЁ])")


def tokens(look: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(look)]


def statistics(text: str | None, letters: Letters) -> tuple:
    """n_words, mean_word, symbol_ratio, digit_ratio, end_lines, common_share, distances to prose and to the nearest
    other profile, and the nearest structure, of one text."""
    return nearest([counted(text, letters)])[0]


def counted(text: str | None, letters: Letters) -> tuple:
    """The basic counts of a text (six values), its class counts, and its traits."""
    if not text:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0), None, None
    look = folded(text)[0].replace("\\r", "\n").replace("\\n", "\n")
    got = tokens(look)
    words = [t.lower() for k, t in got if k == "word"]
    times = Counter(words)
    n = len(words)
    # Each letter read wrongly leaves one of two capitals.
    broken = not text.isascii() and 4 * (text.count("Р") + text.count("С")) > sum(map(len, words)) and wrongly_decoded(text)
    counts = dict.fromkeys(CLASSES, 0)
    often = {w for w, c in times.items() if n >= 6 and c > REPEAT_SHARE * n and c > 2} if n else set()
    senseless = SENSELESS_WORD if n >= 5 and letters.mean(words) < SENSELESS_BELOW else ODD_BELOW
    wide = columns(look)
    kinds = letters.kinds
    soft = sure = 0
    before = None
    start = True
    for i, (kind, t) in enumerate(got):
        if kind == "word":
            start = False
            before = kind
            w = t.lower()
            if broken:
                c = "odd"
            elif w in often:
                c = "repeat"
            else:
                c, certain, mean = kinds.get(w) or letters.kind(w)
                if mean < senseless or c != "connect" and c != "place" and not (w == t or t.istitle() or t.isupper()) and _case_noise(t):
                    c = "odd"
                elif certain:
                    sure += 1
            counts[c] += 1
            continue
        if start and _MARK.match(t + " ") and kind in ("symbol", "data") or start and kind == "data" and t.isdigit() and i + 1 < len(got) and got[i + 1][1] in (")", "."):
            nxt = got[i + 1][1] if i + 1 < len(got) else ""
            counts["mark"] += t not in "—>" or 1
            start = nxt in ")." and kind == "data"
            before = "mark"
            continue
        if before == "mark" and t in (")", ".") and start:
            start = False
            continue
        start = False
        if kind == "line":
            start = True
            nxt = got[i + 1] if i + 1 < len(got) else None
            if before not in ("end", "comma", None) or nxt and nxt[0] == "symbol" and _MARK.match(nxt[1] + " "):
                # A line that goes on in small letters is wrapped, not broken.
                if nxt and not (nxt[0] == "word" and nxt[1][0].islower() and before in ("word", "data")):
                    counts["break"] += 1
                elif nxt:
                    soft += 1
        elif kind == "sep" and t.isspace() and not wide:
            continue
        elif kind == "data":
            if len(t) > 8 and re.search(r"[A-Za-z]\d+[A-Za-z]+\d", t) and "@" not in t:
                counts["odd"] += 1
            else:
                counts["number"] += 1
        else:
            counts[kind] += 1
        before = kind
    if not any(counts.values()):
        counts["symbol"] = 1
    items = counts["comma"] + counts["break"] + counts["mark"] + (soft if soft > 1 else 0)
    # Nothing runs between the items: then soft line breaks part items too, and the text is no prose.
    still = items >= 3 and not counts["connect"] and not sure and 4 * counts["verb"] <= items and counts["place"] < 0.2 * n
    if still:
        counts["break"] += soft
    # The second distribution: items, columns, labelled values, and that nothing runs.
    traits = {"items": counts["mark"] >= 3 or counts["break"] >= 2 or counts["comma"] >= 3, "columns": counts["sep"] >= 4 or counts["comma"] >= 6 and counts["break"] >= 2, "labels": counts["field"] >= 2, "still": still}
    bare = "".join(look.split())
    signs, digits = len("".join(_SIGN.findall(bare))), len("".join(_DIGIT.findall(bare)))
    lines = [x.rstrip() for x in look.split("\n") if x.strip()]
    basic = (n, sum(map(len, words)) / n if n else 0.0, signs / max(1, len(bare)), digits / max(1, len(bare)), sum(x[-1] in ".!?…" for x in lines) / max(1, len(lines)), (counts["connect"] + counts["place"]) / max(1, n))
    return basic, [counts[c] for c in CLASSES], [traits[x] for x in TRAITS]


_SIGN, _DIGIT = re.compile(r"[\W_]+"), re.compile(r"\d+")
_NAMES = [name.partition(" ")[0] for name in PROFILES]
_SHARES = np.array(list(PROFILES.values()), float) / 100
TRAITS = ("items", "columns", "labels", "still")
# The traits a structure has or lacks for sure; of the others its profile says nothing.
SURE_TRAITS = {"list": {"items": 1}, "table": {"columns": 1}, "fields": {"labels": 1}, "prose": {"still": 0}, "junk": {}}
#: By profile and trait, whether it is sure, and its value.
_SURE = np.array([[t in SURE_TRAITS[n] for t in TRAITS] for n in _NAMES], float)
_VALUE = np.array([[SURE_TRAITS[n].get(t, 0) for t in TRAITS] for n in _NAMES], float)


def divergences(shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of `shares` from each profile."""

    def part(x, m):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=-1)

    p, q = shares[:, None, :], _SHARES[None, :, :]
    m = (p + q) / 2
    return (part(p, m) + part(q, m)) / 2


def trait_divergences(traits: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of traits from each profile's, summed over what the profile is sure
    of: for two certain values it is 0 if they agree and 1 if they do not."""
    return (np.abs(traits[:, None, :] - _VALUE[None, :, :]) * _SURE[None, :, :]).sum(axis=-1)


def nearest(rows: list[tuple]) -> list[tuple]:
    """Basic counts, divergence from prose, divergence from the nearest other profile, and the structure of each row."""
    at = [i for i, r in enumerate(rows) if r[1] is not None]
    out = [(*r[0], None, None, None) for r in rows]
    if not at:
        return out
    shares = np.array([rows[i][1] for i in at], float)
    d = divergences(shares / shares.sum(axis=1, keepdims=True)) + trait_divergences(np.array([rows[i][2] for i in at], float))
    prose = np.array([n == "prose" for n in _NAMES])
    near, other = d[:, prose].min(axis=1), d[:, ~prose]
    best = other.argmin(axis=1)
    names = [n for n in _NAMES if n != "prose"]
    for i, p, o, k in zip(at, near.tolist(), other.min(axis=1).tolist(), best.tolist()):
        out[i] = (*rows[i][0], p, o, "prose" if p <= o else names[k])
    return out


def wrongly_decoded(text: str) -> bool:
    """Whether the text is UTF-8 that was read as a one-byte encoding: read back, it becomes Cyrillic."""
    if text.isascii():
        return False
    back = text.encode("cp1251", "ignore").decode("utf-8", "ignore")
    return len(_CYRILLIC.findall(back)) > 0.25 * len(_LETTER.findall(text))


_CYRILLIC, _LETTER = re.compile("[а-яА-Я]"), re.compile(r"[^\W\d_]")


def columns(look: str) -> bool:
    """Whether tabs or wide gaps part columns: most lines have the same number of them, two or more."""
    lines = [len(re.findall(r"\t| {3,}", x.strip())) for x in look.split("\n") if x.strip()]
    if len(lines) < 2:
        return False
    n, times = Counter(lines).most_common(1)[0]
    return n >= 2 and times >= 0.6 * len(lines)


def letter_pairs(df: DataFrame, text: str) -> dict[str, int]:
    """Counts of letter pairs over the words of all texts, of alphabets below U+0800. Each task counts its own rows; what
    is gathered is one row for each pair of letters of one word: bounded by the sizes of these alphabets, not by
    the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        words: Counter[str] = Counter()

        def flush():
            for w, n in words.items():
                if judged_word(w):
                    for p in pairs_of(w):
                        seen[p] += n
            words.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                words.update(_LETTERS.findall(t.lower()))
            if len(words) > 100_000:
                flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])

    counted = df.where(F.col(text) != "").select(text).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in counted.collect()}


_LETTERS = re.compile(r"[^\W\d_]+")


def text_statistics(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Statistics and structure of each row's text; one row for each row of `df`. Two passes over the texts, the
    first of which shuffles letter pairs only."""
    texts = spread(df.select(row_id, text))
    shared = df.sparkSession.sparkContext.broadcast(letter_pairs(texts, text))
    kind = df.schema[row_id].dataType.simpleString()
    schema = f"row_id {kind}, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, end_line_share double, common_word_share double, prose_divergence double, other_divergence double, structure string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(shared.value)
        types = [pa.int64()] + [pa.float64()] * 7 + [pa.string()]
        for b in batches:
            rows = nearest([counted(t, letters) for t in b.column(1).to_pylist()])
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["row_id", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_line_share", "common_word_share", "prose_divergence", "other_divergence", "structure"])

    return texts.mapInArrow(run, schema)


def not_prose(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return text_statistics(df, row_id, text).where("structure <> 'prose'").select("row_id")

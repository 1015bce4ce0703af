"""Names of people: words get roles, neighbouring words with roles make runs, and runs are read from the left, the longest
shape first. Roles depend on the word alone, so they are kept: words repeat."""

from __future__ import annotations

import re
from collections.abc import Iterator

from spanveil.functions.names import PATRONYMIC, SURNAME, latin_names, russian_forms
from spanveil.operators.scan import Look, any_in
from spanveil.schema import ANCHORED, HIGH, MEDIUM

Found = Iterator[tuple[int, int, str, float, str]]

# Words that stand before a name; forms of address; labels of a form.
ANCHORS = ("фио", "ф.и.о", "фамилия", "клиент", "заявител", "гражданин", "гражданк", "держател", "плательщик", "получател", "отправител", "абонент", "сотрудник", "меня зовут", "на имя", "client", "name")
GREETINGS = ("уважаемый", "уважаемая", "здравствуйте,", "добрый день,", "господин", "госпожа", "dear", "mr.", "mrs.", "ms.")
LABELS = ("фио", "ф.и.о", "фамилия", "surname", "full name")
#: Given names that are ordinary words, too: alone they prove nothing.
HOMONYMS = frozenset("роман лев вера надежда любовь марк роза лилия майя мир слава ян ева ника лина ася лада клим тихон белла клара герман макар платон лука злата фаина регина марта веры надежды любви романа романы розы славы мире мира миру".split())
# Towns that end like surnames, and words that begin sentences.
TOWNS = frozenset("саратов ростов киров псков тамбов азов серпухов чехов королёв королев камышин пушкин львов харьков краков гомель калинин берлин дублин гатчина пермь могилёв могилев ишим".split())
STOP = frozenset("это этот эта как что где когда если также однако поэтому клиент банк заявка договор карта счёт счет паспорт телефон адрес дата номер сумма оператор менеджер система россия москва просьба прошу уважаемый уважаемая спасибо здравствуйте добрый вечер утро день причина корзина магазин машина кабина дисциплина медицина половина величина глубина вершина равнина долина основа глава слова права дрова".split())
ORGANISATION = re.compile(r"(?:ул|улиц\w*|пер|переул\w*|пр-т|просп\w*|наб|площад\w*|пл|им|имени|ооо|оао|ао|зао|пао|ип|банк\w*)\.?\s*[«\"]?$")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*+")
#: Endings that few other words have; the rest of the surname endings need a neighbour.
STRONG = re.compile(r"[а-яё]{2,}(?:[оеё]в|[оеё]ва|[иы]нск(?:ий|ая|ого|ой|ому)|[оеё]вск(?:ий|ая|ого|ой|ому)|швили|[ое]нко|[ое]вич|[ое]вым|[ое]вой|[ое]ву)$")
NAME, SURN, SURE, FATHER, INITIAL, CAPITAL = 1, 2, 4, 8, 16, 32
CORE = NAME | FATHER
_ROLES: dict[str, int] = {}


def roles_of(word: str) -> int:
    """The roles a word can have by itself, one bit each. Initials are capitals of one letter."""
    got = _ROLES.get(word)
    if got is not None:
        return got
    low = word.lower()
    cyrillic, capital = "Ѐ" <= word[0] <= "ӿ", word[0].isupper()
    out = 0
    if len(word) == 1:
        out = INITIAL if capital else 0
    elif low in STOP:
        out = 0
    elif cyrillic and PATRONYMIC.match(low):
        out = FATHER | (SURN if SURNAME.search(low) else 0)
    else:
        if low in (russian_forms() if cyrillic else latin_names()):
            out |= NAME
        if cyrillic and len(low) > 3 and SURNAME.search(low):
            out |= SURN | (SURE if STRONG.fullmatch(low) and low not in TOWNS else 0)
        elif not cyrillic and capital and len(low) > 2 and not out:
            out |= SURN
        if capital and len(low) > 2 and not out:
            out |= CAPITAL
    if len(_ROLES) > 200_000:
        _ROLES.clear()
    _ROLES[word] = out
    return out


class Word:
    __slots__ = ("start", "end", "roles", "text", "dot", "latin")

    def __init__(self, start: int, end: int, roles: int, text: str, dot: bool):
        self.start, self.end, self.roles, self.text, self.dot = start, end, roles, text, dot
        self.latin = text[0] < "ɐ"


def runs(look: Look) -> Iterator[list[Word]]:
    """Words with roles that stand side by side."""
    text, run, last = look.text, [], None
    greeted = any_in(look.low, GREETINGS)
    for m in _WORD.finditer(text):
        r = roles_of(m[0])
        if not r:
            continue
        s, e = m.span()
        word = Word(s, e, r, m[0], text[e : e + 1] == ".")
        if last is not None and not _beside(text, last, word):
            if len(run) > 1 or greeted or run[0].roles != CAPITAL:
                yield run
            run = []
        run.append(word)
        last = word
    if run and (len(run) > 1 or greeted or run[0].roles != CAPITAL):
        yield run


def _beside(text: str, a: Word, b: Word) -> bool:
    gap = b.start - a.end
    if not 0 < gap <= 3:
        return False
    between = text[a.end : b.start]
    rest = between.strip(" \t. ")
    if rest == ",":
        return bool(a.roles & SURN and b.roles & NAME) and len(a.text) > 1
    return not rest and (len(a.text) == 1 or "." not in between)


def names(look: Look) -> Found:
    for run in runs(look):
        i = 0
        while i < len(run):
            conf, reason, size = _shape(look, run, i)
            if not size:
                i += 1
                continue
            j = i + size
            if j < len(run) and run[j].roles & CAPITAL and run[j - 1].roles & CORE and run[j].latin == run[j - 1].latin and not (reason.startswith("fio:surname") or size > 2):
                size += 1  # an unknown word with a capital behind a given name or patronymic
            first, last = run[i], run[i + size - 1]
            start, end = first.start, last.end + (len(last.text) == 1 and last.dot)
            if ORGANISATION.search(look.low, max(0, start - 16), start) is None:
                yield start, end, "FIO", conf, ("fio:latin+" + reason[4:]) if first.latin and last.latin else reason
            i += size


def _sentence_start(look: Look, start: int) -> bool:
    left = look.text[max(0, start - 4) : start].rstrip(" \t")
    return not left or left[-1] in ".!?\n\r:;"


def _shape(look: Look, run: list[Word], i: int) -> tuple[float, str, int]:
    a = run[i]
    if a.roles == CAPITAL:
        # An unknown word with a capital counts before a given name, or behind a form of address.
        if i + 1 < len(run) and run[i + 1].roles & CORE and run[i + 1].latin == a.latin and not _sentence_start(look, a.start):
            conf, reason, size = _known(look, run, i + 1)
            if size:
                return conf, "fio:cap+" + reason[4:], size + 1
        if any_in(look.low[max(0, a.start - 16) : a.start], GREETINGS):
            return ANCHORED, "fio:greeting", 1
        return 0.0, "", 0
    return _known(look, run, i)


def _known(look: Look, run: list[Word], i: int) -> tuple[float, str, int]:
    n = len(run) - i
    a = run[i]
    if n > 2:
        b, c = run[i + 1], run[i + 2]
        x, y, z = a.roles, b.roles, c.roles
        if a.latin == b.latin == c.latin or INITIAL in (x, y, z):
            if x & SURN and y & NAME and z & FATHER or x & NAME and y & FATHER and z & SURN or x & NAME and y & SURN and z & FATHER or x & NAME and y & NAME and z & FATHER:
                return HIGH, "fio:surname+name+patronymic", 3
            if (x & SURN and y == z == INITIAL and (b.dot or c.dot) or x == y == INITIAL and z & SURN and (a.dot or b.dot)) and (a if x & SURN else c).text[0].isupper():
                return HIGH, "fio:initials", 3
            if x & SURN and y & NAME and z == INITIAL and c.dot or x & NAME and y == INITIAL and b.dot and z & SURN:
                return HIGH, "fio:initials", 3
    if n > 1:
        b = run[i + 1]
        x, y = a.roles, b.roles
        if a.latin == b.latin:
            if x & NAME and y & FATHER:
                return HIGH, "fio:name+patronymic", 2
            if x & FATHER and y & SURN and b.text[0].isupper() == a.text[0].isupper():
                return HIGH, "fio:patronymic+surname", 2
            if x & SURN and y == INITIAL and b.dot and a.text[0].isupper() and not a.latin or x == INITIAL and a.dot and y & SURN and b.text[0].isupper() and not b.latin:
                return HIGH, "fio:initials", 2
            if (x & NAME and y & SURN or x & SURN and y & NAME) and _same_case(a.text, b.text):
                surname = b if x & NAME and y & SURN else a
                sure = surname.roles & SURE or surname.latin or surname.text[0].isupper()
                return (HIGH, "fio:name+surname", 2) if sure else (MEDIUM, "fio:lower_pair", 2)
    return _single(look, a)


def _same_case(a: str, b: str) -> bool:
    return a[0].isupper() == b[0].isupper() and (a.isupper() == b.isupper() or "-" in a + b)


def _single(look: Look, a: Word) -> tuple[float, str, int]:
    r, capital = a.roles, a.text[0].isupper()
    if r == INITIAL:
        return 0.0, "", 0
    if r & FATHER and not a.latin:
        return (ANCHORED, "fio:patronymic", 1) if capital or look.has(a.start, a.start, ANCHORS, 24, 0) else (0.0, "", 0)
    left = look.low[max(0, a.start - 24) : a.start]
    if capital and r & (NAME | SURN) and not a.latin and any_in(left, ANCHORS):
        return ANCHORED, "fio:anchor", 1
    if a.latin:
        return 0.0, "", 0
    if r & NAME and capital and a.text.lower() not in HOMONYMS:
        return ANCHORED, "fio:name", 1
    if r & SURE and capital and not a.text.isupper() and not _sentence_start(look, a.start):
        return MEDIUM, "fio:surname_suffix", 1
    if r & SURN and not capital and any_in(left, LABELS):
        return MEDIUM, "fio:lower_surname", 1
    return 0.0, "", 0

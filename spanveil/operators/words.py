"""Findings that need word-by-word reading: names, dates, addresses, places of birth, issuers, citizenship, card
holders. One Arrow function reads each text once and gives these and the findings among numbers and patterns; a failure
in one reader drops its types only.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import NUMBER_WORDS
from spanveil.operators import numeric, patterns, people, places
from spanveil.operators.scan import Look, any_in, nearly_equal
from spanveil.schema import ANCHORED, HIGH, MEDIUM, SPANS

Found = Iterator[tuple[int, int, str, float, str]]
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("conf", pa.float64()), ("reason", pa.string())]))
TRIM = " \t\r\n .,;:!?\"'«»()[]{}<>№#-–—/\\"

# Stems of month names by number.
MONTHS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "ма": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12, "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12}
_NUMERIC_DATE = re.compile(r"(?<![\d.])(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?![\d]|\.\d)|(?<!\d)(\d{4})([./-])(\d{1,2})\6(\d{1,2})(?!\d)")
_WORD_DATE = re.compile(r"(?<!\d)(\d{1,2})(?:-?го|th|st|nd|rd)?\s{1,4}([a-zа-яё]{3,10})\.?,?\s{1,4}(\d{4})(?!\d)(?:\s{0,2}(?:года|год|г\.?))?")
_MONTH_FIRST = re.compile(r"(?<!\w)((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6})\s{1,4}(\d{1,2})(?:th|st|nd|rd)?,?\s{1,4}(\d{4})(?!\d)")
#: Stems without which no month is written in words.
MONTH_SIGNS = tuple(m for m in MONTHS if m != "ма") + ("май", "мая", "мае")
BIRTH = ("рожд", "родил", "д.р", "д/р", "г.р", "г. р", "born", "birth", "dob")
ISSUED = ("выдан", "выдач", "issued", "date of issue")
DOCUMENT = ("паспорт", "passport", "удостоверени", "свидетельств", "документ")
NO_DATE = ("срок", "договор", "заявк", "заказ", "платеж", "отправлен", "вступает", "утвердили", "от ")
PERSONAL = ("клиент", "гражданин", "фио", "паспорт", "снилс", "инн", "прожива")


def dates(look: Look, as_of_year: int, mode: str) -> Found:
    """Valid calendar dates, told apart by the nearest anchor."""
    low, runs = look.low, look.runs
    sizes = {g for r in runs for g in r.groups}
    wordy = any_in(low, MONTH_SIGNS)
    triples = any(len(r.groups) > 2 and not _DATE_SEPS.isdisjoint(r.seps) for r in runs)
    for m in _NUMERIC_DATE.finditer(low) if triples else ():
        if m[1]:
            day, month, year = int(m[1]), int(m[3]), _year(m[4], as_of_year)
            if month > 12 and day <= 12:
                day, month = month, day
        else:
            year, month, day = _year(m[5], as_of_year), int(m[7]), int(m[8])
        if year and _valid(year, month, day):
            yield from _dated(m.start(), m.end(), low, mode)
    for m in _COMPACT.finditer(low) if 8 in sizes else ():
        # Eight digits are a date only behind a word for one.
        if _near_date(low, m.start()):
            for day, month, year in ((m[0][:2], m[0][2:4], m[0][4:]), (m[0][6:], m[0][4:6], m[0][:4])):
                if 1900 <= int(year) <= as_of_year and _valid(int(year), int(month), int(day)):
                    yield from _dated(m.start(), m.end(), low, mode)
                    break
    english = any_in(low, _ENGLISH)
    worded = [(m, m[1], m[2], m[3]) for m in (_WORD_DATE.finditer(low) if 4 in sizes else ())] + [(m, m[2], m[1], m[3]) for m in (_MONTH_FIRST.finditer(low) if english and 4 in sizes else ())]
    for m, day, word, year in worded:
        month = month_of(word)
        if month and 1900 <= int(year) <= as_of_year and _valid(int(year), month, int(day)):
            yield from _dated(m.start(), m.end(), low, mode)
    if wordy:
        for start, end in spelled_dates(low, as_of_year):
            yield from _dated(start, end, low, mode)
    if 4 in sizes and any_in(low, ("рожд", "г.р", "г. р", "г р", "гр")):
        for m in _BIRTH_YEAR.finditer(low):
            if int(m[0]) <= as_of_year:
                yield from _dated(m.start(), m.end(), low, mode)


@lru_cache(10_000)
def month_of(word: str) -> int:
    """The number of the month a word names, misspelt by one edit behind its first three letters at most; else 0."""
    for stem, n in MONTHS.items():
        if word.startswith(stem) and len(word) - len(stem) <= 3 and (stem != "ма" or word in ("май", "мая", "маю", "маем", "мае")):
            return n
    if len(word) >= 5:
        for stem, n in MONTHS.items():
            if len(stem) >= 4 and word[:3] == stem[:3] and any(nearly_equal(word, stem + end) for end in (("а", "я", "ь", "е", "") if stem[0] > "z" else ("",))):
                return n
    return 0


_DATE_SEPS = frozenset("./-")
_ENGLISH = tuple(m[:3] for m in MONTHS if m[0] < "z")
_COMPACT = re.compile(r"(?<![\d./-])\d{8}(?![\d./-])")


def _near_date(low: str, start: int) -> bool:
    left = low[max(0, start - 32) : start]
    return any_in(left, ("дата", "рожд", "д.р", "выдан", "выдач", "date", "birth", "dob", "issued")) and not re.search(r"\d", left[max(map(left.rfind, ("дат", "рожд", "д.р", "выда", "date", "birth", "dob", "issued"))) :])


# Stems of ordinal numbers by value; cardinal ones are shared with the column functions.
ORDINALS = {"перв": 1, "втор": 2, "трет": 3, "четверт": 4, "четвёрт": 4, "пят": 5, "шест": 6, "седьм": 7, "восьм": 8, "девят": 9, "десят": 10, "одиннадцат": 11, "двенадцат": 12, "тринадцат": 13, "четырнадцат": 14, "пятнадцат": 15, "шестнадцат": 16, "семнадцат": 17, "восемнадцат": 18, "девятнадцат": 19, "двадцат": 20, "тридцат": 30, "сороков": 40, "пятидесят": 50, "шестидесят": 60, "семидесят": 70, "восьмидесят": 80, "девяност": 90, "двухтысячн": 2000}
_ORDINAL_END = re.compile(r"(?:ое|ого|ый|ой|ье|ьего|ий|ом|ьем)$")
_MONTH_WORD = re.compile(r"(?<!\w)(?:" + "|".join(f"{m}[а-я]{{0,3}}" for m in MONTHS if m[0] > "z") + r")(?!\w)")
_BIRTH_YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?=\s*(?:г\.?\s?р\.?(?!\w)|года?\s+рождения))")


def _number_word(word: str) -> int | None:
    if word.startswith("тысяч"):
        return 1000
    if word in NUMBER_WORDS:
        return NUMBER_WORDS[word]
    stem = _ORDINAL_END.sub("", word)
    return ORDINALS.get(stem) if stem != word else None


def spelled_dates(low: str, as_of_year: int) -> Iterator[tuple[int, int]]:
    """Dates whose day and year are written in words."""
    for m in _MONTH_WORD.finditer(low):
        left = [w for w in re.finditer(r"[а-яё]+", low[max(0, m.start() - 40) : m.start()])][-2:]
        offset = max(0, m.start() - 40)
        day, start = 0, m.start()
        for w in reversed(left):
            v = _number_word(w[0])
            if v is None or v > 31:
                break
            day, start = day + v, offset + w.start()
        total = part = 0
        end = m.end()
        for w in re.finditer(r"[а-яё]+", low[m.end() : m.end() + 80]):
            v = _number_word(w[0])
            if v is None:
                break
            if v == 1000:
                total, part = total + 1000 * max(1, part), 0
            else:
                part += v
            end = m.end() + w.end()
        month = next((n for stem, n in MONTHS.items() if m[0].startswith(stem)), 0)
        if 1900 <= total + part <= as_of_year and day and _valid(total + part, month, day):
            yield start, end


def _year(digits: str, as_of_year: int) -> int:
    n = int(digits)
    if len(digits) == 2:
        n += 2000 if n <= as_of_year % 100 else 1900
    return n if 1900 <= n <= as_of_year else 0


def _valid(year: int, month: int, day: int) -> bool:
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= month <= 12 and 1 <= day <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def _dated(s: int, e: int, low: str, mode: str) -> Found:
    left, right = low[max(0, s - 48) : s], low[e : e + 24]

    def nearest(words):
        back = min((len(left) - left.rfind(w) for w in words if w in left), default=999)
        return min(back, min((right.find(w) + 24 for w in words if w in right), default=999))

    birth, issue = nearest(BIRTH), nearest(ISSUED)
    if birth < 999 or issue < 999:
        yield (s, e, "DOB", HIGH, "dob:birth_anchor") if birth <= issue else (s, e, "ISSUE_DATE", HIGH, "issue:issue_anchor")
    elif any(w in left for w in NO_DATE):
        return
    elif any(w in low[max(0, s - 120) : s] for w in DOCUMENT):
        yield s, e, "ISSUE_DATE", ANCHORED, "issue:document_context"
    elif mode == "any" or mode == "pii_context" and any(w in low[max(0, s - 80) : e + 80] for w in PERSONAL):
        yield s, e, "DOB", MEDIUM, f"dob:{mode}"


BIRTH_PLACE = re.compile(r"(?:место\s{1,3}рождения|место\s{1,3}рожд\.?|м\.\s?р\.|уроженец|уроженка|родил(?:ся|ась)\s{1,3}в|place of birth|born in)[\s:=—–|(\[«\"-]{0,5}(?:в\s{1,3})?")
_PLACE = re.compile(r"(?:(?:г|гор|город|с|село|пос|дер|деревня|обл|респ)\b\.?\s*)?[^\W\d_][\w-]*(?:\s+(?:обл\w*|край|район\w*|респ\w*))?(?:,\s*(?:г|гор|город|с|село|пос)\b\.?\s*[^\W\d_][\w-]*)?")


#: A value that stands before its anchor: at the start of a line, field or quotation, a dash or a bracket behind it.
_VALUE_BEFORE = re.compile(r"(?:^|[\n:;|•«\"(])[ \t]{0,4}([^\n:;|•«»\"()—–]{2,60}?)[»\"]?[ \t]{0,4}(?:[—–-]|\()[ \t]{0,4}$")
_ANCHOR_ENDS = re.compile(r"[ \t]{0,4}(?:\)|$|[\n\r.;|])")


def _value_before(low: str, m: re.Match) -> tuple[int, int] | None:
    """The value on the left of an anchor that has none on its right."""
    end = m.end() - (len(m[0]) - len(m[0].rstrip(" \t\n\u00a0:=—–|([«\"-")))
    if not _ANCHOR_ENDS.match(low, end):
        return None
    start = max(0, m.start() - 80)
    v = _VALUE_BEFORE.search(low[start : m.start()])
    return (start + v.start(1), start + v.end(1)) if v else None


def birth_places(text: str, low: str) -> Found:
    if not any_in(low, ("рожд", "р.", "урожен", "родил", "birth", "born")):
        return
    for m in BIRTH_PLACE.finditer(low):
        left = _value_before(low, m)
        if left:
            yield *left, "BIRTH_PLACE", HIGH, "birth_place:before_anchor"
            continue
        v = _PLACE.match(low, m.end())
        if v and v.end() - v.start() <= 60:
            s, e = _trim(text, v.start(), v.end())
            if s < e:
                yield s, e, "BIRTH_PLACE", HIGH, "birth_place:anchor"


ISSUER_ANCHOR = re.compile(r"(?:кем\s{1,3}выдан|выдан[оа]?|орган\s{1,3}выдачи|наименование\s{1,3}органа)[\s:=—–|(\[«\"-]{0,5}")
AGENCY = re.compile(r"(?<!\w)(?:овд|увд|гувд|мвд|умвд|гу\s+мвд|уфмс|оуфмс|фмс|отдел\w*\s+(?:внутренних|милиции|полиции|миграции|по вопросам миграции|уфмс|овд)|отделени\w*\s+\w+|паспортн\w+\s+стол\w*)")
_ISSUER_END = re.compile(r"[.;\n\r(]|,\s*(?!район|област|участок|в\s)|\d{1,2}[./-]\d|\d{3}-\d{3}|код\s+подр|дата|$")


def issuers(text: str, low: str) -> Found:
    if not any_in(low, ("выда", "орган", "паспорт", "passport")):
        return
    taken = 0
    for m in ISSUER_ANCHOR.finditer(low):
        left = _value_before(low, m)
        if left and AGENCY.search(low, *left):
            taken = left[1]
            yield *left, "ISSUER", HIGH, "issuer:before_anchor"
            continue
        end = _ISSUER_END.search(low, m.end())
        s, e = _trim(text, m.end(), min(end.start() if end else len(low), m.end() + 160))
        if s < e and AGENCY.search(low, s, e):
            taken = e
            yield s, e, "ISSUER", HIGH, "issuer:anchor"
    for m in AGENCY.finditer(low):
        if m.start() >= taken and any(w in low[max(0, m.start() - 90) : m.start()] for w in ("паспорт", "passport")):
            end = _ISSUER_END.search(low, m.end())
            s, e = _trim(text, m.start(), min(end.start() if end else len(low), m.start() + 160))
            taken = e
            yield s, e, "ISSUER", ANCHORED, "issuer:agency_near_passport"


CITIZENSHIP = re.compile(r"(?:гражданство|гражданства|гражданин|гражданка|citizenship|citizen of)[\s:=—–|(\[«\"-]{0,5}")
# Beginnings of country names.
COUNTRY = ("росси", "рф", "российск", "казахст", "белар", "белорус", "украин", "узбекист", "таджикист", "киргиз", "кыргыз", "армени", "азербайдж", "груз", "молдов", "туркм", "латви", "литв", "эстон", "герман", "франц", "китай", "китая", "турци", "израил", "сша", "польш", "russia", "kazakh", "belarus", "ukrain", "german", "без гражданства")


def citizenships(text: str, low: str) -> Found:
    if not any_in(low, ("граждан", "citizen")):
        return
    for m in CITIZENSHIP.finditer(low):
        left = _value_before(low, m)
        if left and any(w.startswith(COUNTRY) for w in low[left[0] : left[1]].split()):
            yield *left, "CITIZENSHIP", HIGH, "citizenship:before_anchor"
            continue
        words = list(re.finditer(r"[^\W\d_][\w-]*", low[m.end() : m.end() + 60]))[:4]
        hit = [w for w in words if w[0].startswith(COUNTRY)]
        if hit and words.index(hit[0]) <= 2:
            last = hit[-1]
            yield m.end() + words[0].start(), m.end() + last.end(), "CITIZENSHIP", HIGH, "citizenship:anchor"


HOLDER = re.compile(r"(?:держатель(?:\s+карты)?|владелец(?:\s+карты)?|имя\s+на\s+карте|cardholder(?:\s+name)?|name on card)[\s:=—–|(«-]{0,5}")
_LATIN_NAME = re.compile(r"(?<![\w.@-])[A-Z][A-Z'-]+(?:\s[A-Z][A-Z'-]+){1,2}(?![\w@])")
CARD_NEAR = re.compile(r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)|(?<!\d)(?:0[1-9]|1[0-2])/\d\d(?!\d)|visa|mastercard|maestro")


_HOLDER_NAME = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)?(?:[ ][^\W\d_]+(?:[-'][^\W\d_]+)?){0,2}")


def holders(text: str, low: str) -> Found:
    for m in HOLDER.finditer(low) if any_in(low, ("держател", "владел", "имя", "holder", "name on")) else ():
        v = _HOLDER_NAME.match(text, m.end())
        if v:
            yield m.end(), v.end(), "CARDHOLDER", HIGH, "cardholder:anchor"
    for m in _LATIN_NAME.finditer(text):
        if CARD_NEAR.search(low[max(0, m.start() - 120) : m.end() + 120]):
            yield m.start(), m.end(), "CARDHOLDER", ANCHORED, "cardholder:near_card"


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in TRIM:
        s += 1
    while e > s and text[e - 1] in TRIM:
        e -= 1
    return s, e


def _plain(reader):
    return lambda look: reader(look.text, look.low)


def _either(reader):
    """Reads the text as it is and, where that gives nothing, with look-alike letters folded."""

    def read_both(look):
        found = list(reader(look.text, look.low))
        return found or (list(reader(look.text, look.fold)) if look.fold != look.low else found)

    return read_both


NUMERIC = ("PHONE", "CARD", "SNILS", "INN", "DRIVER_LICENSE", "PASSPORT", "DEPT_CODE", "POSTCODE", "CVV", "PIN")
DOCUMENTS = ("SNILS", "FOREIGN_PASSPORT", "BIRTH_CERT", "MILITARY_ID", "RESIDENCE_PERMIT")
EXTRAS = ("ACCOUNT", "OMS", "PLATE", "VIN", "IP_ADDRESS")
#: Name, what it can find, reader. In the order in which they run, which decides between equal spans.
READERS: list[tuple[str, tuple[str, ...], Callable]] = [
    ("number", NUMERIC, numeric.numbers), ("email", ("EMAIL",), patterns.emails), ("name", ("FIO",), people.names), ("date", ("DOB", "ISSUE_DATE"), None), ("address", ("ADDRESS",), places.addresses),
    ("birth_place", ("BIRTH_PLACE",), _either(birth_places)), ("issuer", ("ISSUER",), _either(issuers)), ("citizenship", ("CITIZENSHIP",), _either(citizenships)),
    ("driver_letters", ("DRIVER_LICENSE",), patterns.driver_letters), ("holder", ("CARDHOLDER",), _plain(holders)), ("document", DOCUMENTS, patterns.documents), ("extra", EXTRAS, patterns.extras),
]


def register(name: str, types: tuple[str, ...], reader: Callable[[Look], Found]) -> None:
    """Adds a reader, or puts another one in the place of that name. Readers run inside executors, so it must be
    registered before a query is built, and its module must be there on the executors."""
    entry = (name, tuple(types), reader)
    for k, (n, _, _) in enumerate(READERS):
        if n == name:
            READERS[k] = entry
            return
    READERS.append(entry)


def read(text: str | None, wanted: frozenset[str], as_of_year: int, mode: str, readers: list | None = None) -> list[tuple]:
    """All findings of one text. NULL and empty texts have none."""
    if not text:
        return []
    look = Look(text)
    out = []
    for name, types, reader in READERS if readers is None else readers:
        if not wanted.intersection(types):
            continue
        try:
            found = list(dates(look, as_of_year, mode) if reader is None else reader(look))
        except Exception:  # noqa: BLE001
            # The text's other types stay; the failure shows as a finding of no length, which resolution drops.
            found = [(0, 0, types[0], 0.0, "failed")]
        out += [x for x in found if x[2] in wanted]
    return out


_FIELDS = ("start", "end", "type", "conf", "reason")


def as_array(rows: list[list[tuple]]) -> pa.Array:
    """Lists of spans as one Arrow array, column by column."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    columns = list(zip(*itertools.chain.from_iterable(rows))) or [()] * 5
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPE.value_type)], fields=list(_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def found_spans(text: Column, wanted: tuple[str, ...], as_of_year: int = 2026, date_mode: str = "pii_context") -> Column:
    """All findings of the wanted types: one Arrow call that reads each text once."""
    types, readers = frozenset(wanted), list(READERS)

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return as_array([read(x, types, as_of_year, date_mode, readers) for x in texts.to_pylist()])

    # Marked so, the optimiser neither repeats nor moves the call: each text is read once.
    return spans.asNondeterministic()(text)


def number_singles(text: Column) -> Column:
    """Findings among numbers, each number by itself."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return as_array([list(numeric.singles(Look(x))) if x else [] for x in texts.to_pylist()])

    return spans.asNondeterministic()(text)

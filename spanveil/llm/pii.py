"""Personal information inside free text: found, and replaced by typed placeholders.

Method: anchor expansion. One Aho-Corasick pass over the folded text gives the places of all anchors: at-signs and
their spellings, schemes, cues of numbers, kinds of streets, given names, ends of patronymics, titles, initials. Groups
of digits, which no list can hold, are anchors too. From each anchor a small deterministic parser expands to both sides
and validates what it finds (domain zones, digit groups, checksums, house numbers, neighbouring words). No pattern is
searched for over a whole text; a parser reads the words beside its anchor only, so the time is linear in the text.

Text is folded first (invisible characters, full-width forms and look-alike letters), with offsets kept, so spans
refer to the text as it stands. Kinds: EMAIL, PHONE, ID_NUMBER (passport, INN, SNILS), ADDRESS, NAME. Cards and
accounts (FINANCIAL) are parsed as well, so that no part of one is read as a phone or an identity number; they are
reported and replaced only where asked for, as they are no personal information in this project's terms.

Defined results: NULL and empty texts have no spans and are returned as they are. Placeholders already in a text
are left alone. Overlapping finds are resolved by kind in the order of KINDS, then by length, then by place. Digit
groups further apart than GAP_CHARS are different numbers.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.names import latin_names, russian_forms
from spanveil.functions.validators import inn_valid, luhn_valid, snils_valid
from spanveil.llm.lookalike import MARKED, SAFE, canonical_words, compiled
from spanveil.runtime import spread

KINDS = ("EMAIL", "ADDRESS", "ID_NUMBER", "PHONE", "NAME")
#: Found and left alone unless asked for.
FINANCIAL = ("CARD", "ACCOUNT")
_RANK = {k: i for i, k in enumerate((*FINANCIAL, *KINDS))}

#: Given names that are ordinary words too; alone beside a word in small letters they prove nothing.
COMMON = set("роман лев вера надежда любовь марк роза лилия майя мир слава ян ева ника лина ася лада клим тихон белла клара rose violet grant mark will may jean jack drew victor duncan noel basil norman juniper florence diana герман макар платон лука злата фаина регина марта".split())
# Words that name a kind of street.
STREET = "улица улице улицы ул переулок переулке переулка пер проезд проезде проезда пр-д проспект проспекте проспекта пр-т пр-кт шоссе ш набережная набережной наб бульвар бульваре бульвара б-р площадь площади пл тракт тракте аллея аллее тупик тупике туп".split()
LATIN_STREET = "street st lane ln road rd avenue ave way row drive dr court ct close place pl square sq terrace crescent gardens mews boulevard blvd walk grove quay yard alley parade".split()
# Cues of numbers, as they begin.
CUES = {"инн": "inn", "налогов": "inn", "tax id": "inn", "tax number": "inn", "taxpayer": "inn", "снилс": "snils", "пенсионн": "snils", "страхов": "snils", "snils": "snils", "паспорт": "passport", "passport": "passport", "серия": "passport", "документ": "passport", "удостоверение личности": "passport"}
PHONE_CUES = ("тел", "tel:", "звон", "phone", "call", "reach", "моб", "контакт", "номер для связи", "whatsapp", "факс", "связ", "абонент")
SERIES_CUES = ("сери",)
ACCOUNT_CUES = ("счёт", "счет", "р/с", "к/с", "account", "iban")
#: How far a cue reaches to the right.
REACH, PHONE_REACH = 48, 40
TITLES = set("mr mrs ms miss dr prof sir madam г-н г-жа господин госпожа гражданин гражданка товарищ".split())
#: The at-sign and the dot of an address, and their spellings.
_AT = re.compile(r"\s{0,4}[\(\[{<]\s{0,4}(?:at|собака|эт)\s{0,4}[\)\]}>]\s{0,4}|\s{0,4}@\s{0,4}|\s{1,4}(?:собака|эт)\s{1,4}", re.I)
_AT_WORD = re.compile(r"\s{1,4}at\s{1,4}", re.I)
_DOT = re.compile(r"\.|\s{0,4}[\(\[{<]\s{0,4}(?:dot|точка)\s{0,4}[\)\]}>]\s{0,4}|\s{1,4}(?:dot|точка)\s{1,4}", re.I)
_DOT_WORD = re.compile(r"\s{1,4}(?:dot|точка)\s{1,4}", re.I)
_LABEL, _LOOSE_LABEL, _ZONE = re.compile(r"[^\W_](?:[\w\-]*[^\W_])?"), re.compile(r"[^\W_][\w.\-]*+"), re.compile(r"[^\W\d_]{2,24}")
_LOCAL = re.compile(r"[\w.+\-]")
#: What may stand between two groups of digits of one number: blanks, a line break, two signs.
_JOINT = re.compile(r"[ \t]*+[\n\r]?[ \t]*+[\-–—‑.()/\\]?[ \t]*+[\-–—‑.()/\\]?[ \t]*+")
GAP_CHARS = 16
_DIGITS = re.compile(r"\d+")
_SERIES = re.compile(r"сери[яиюей]{1,4}\W{0,3}(\d\d\s?\d\d)\W{0,4}(?:номер|№|n|no)?\W{0,4}(\d{6})(?!\w)", re.I)
_SIGNED = re.compile(r"(?<![\w.])(\d{4}|\d\d[ \t]\d\d)[ \t]{0,4}(?:№|N|n|No|no|номер)\.?[ \t]{0,4}(\d{6})(?!\w)")
_INITIALS = r"(?:[А-ЯЁA-Z]\.\s?(?:[А-ЯЁA-Z]\.)?|[а-яё]\.\s?[а-яё]\.)"
_INITIALS_HERE = re.compile(_INITIALS)
_SURNAME_AFTER = re.compile(r"\s?([^\W\d_]{3,40}(?:-[^\W\d_]{3,40})?)")
_SURNAME_BEFORE = re.compile(r"(?<![\w./№])([^\W\d_]{3,40}(?:-[^\W\d_]{3,40})?),?\s$")
_AFTER = re.compile(r"\s([А-ЯЁ][а-яё]{2,}|[А-ЯЁ]{3,})")
_ADJECTIVE = re.compile(r"(?:ый|ий|ой|ая|ые|их|ых)$", re.I)
_SURNAME_END = re.compile(r"(?:[оеё]в|[иы]н|[сц]кий|[сц]кой|[оеё]ва|[иы]на|[сц]кая|ый|ая|ой|ец|[иы]х|ко|[аую]к|ян|дзе|швили|ев[аоуы]|ов[ауы]м?|ин[ауы]м?|евой|овой|иной|ского|скому|ским|ской|скую)$", re.I)
_LATIN_SURNAME_END = re.compile(r"(?:ov|ev|in|yn|skiy|sky|skii|ova|eva|ina|skaya|yy|aya|oy|ets|ko|uk|yan)$", re.I)
_PATRONYMIC = re.compile(r"^[а-яё]{2,}(?:ович|евич|ич)(?:а|у|ем|е)?$|^[а-яё]{2,}(?:овн|евн|ичн|иничн)(?:а|ы|е|у|ой)$", re.I)
_LATIN_PATRONYMIC = re.compile(r"^[a-z]{2,}(?:ovich|evich|ovna|evna|ichna)$", re.I)
_NAME_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
# Words that follow a given name in running English or Russian without being a surname.
STOP = set("a an and are as asked at be been but by called can could did do does for from had has have he her his i if in is it its lives may me my no not of on or our said she signed so that the their them then they this to us was we were who will with would you your и в на по от до из за не но а что как это был была было уже ещё ли же бы он она они мы вы я с со у к о об при для без просит звонил звонила подписал подписала".split())
_STREET_BEFORE = re.compile(r"(?:улиц[аеыу]|ул|переул\w*|пер|проезд\w*|пр-д|проспект\w*|пр-т|площад\w*|пл|им|имени|наб|набережн\w*|бульвар\w*|б-р)\.?\s*$", re.I)
_NAMED = r"[^\W\d_]++(?:[-.][^\W\d_]++)*+"
_HOUSE = r"(?:д(?:ом[а-я]{0,2})?\b\.?\s{0,4}(?:№\s{0,4})?)?\d{1,4}(?!\d|[.,]\d)"
#: From a kind of street to the right: its name and the house; or the house alone, the name being on the left.
_STREET_HOUSE = re.compile(rf"\.?\s{{0,4}}(?:(?:им|имени)\.?\s{{0,4}})?[«\"]?(?:\d{{1,2}}-?[а-я]{{1,2}}\s{{1,4}})?{_NAMED}(?:\s{{1,4}}{_NAMED}){{0,2}}?[»\"]?\s{{0,4}},?\s{{0,4}}{_HOUSE}", re.I)
_HOUSE_AFTER = re.compile(rf"\.?\s{{0,4}},?\s{{0,4}}{_HOUSE}", re.I)
_NAME_BEFORE = re.compile(rf"(?<![\w-]){_NAMED}\s{{1,4}}$", re.I)
_ADDRESS_TAIL = re.compile(r"\s{0,4}[-/]\s{0,4}\d{1,4}|\s{0,4}[а-яa-z]\b(?=\W|$)(?<=\d\w)|\s{0,4},?\s{0,4}(?:корп(?:ус)?|к|стр(?:оение)?|кв(?:артира)?|оф(?:ис)?|flat|apt)\b\.?\s{0,4}\d{1,4}", re.I)
_ADDRESS_HEAD = re.compile(rf"(?:(?:\d{{6}},?\s{{0,4}})?(?:(?:г|гор|город|с|село|пос|посёлок|дер|деревня)\b\.?\s{{0,4}})?{_NAMED},\s{{0,4}}|(?:г|гор|город)\b\.?\s{{0,4}}{_NAMED},?\s{{0,4}})$", re.I)
_LATIN_BEFORE = re.compile(r"(?<![\w.,/-])\d{1,4}[a-z]?\s{1,4}([^\W\d_]+(?:['’-][^\W\d_]+)?(?:\s{1,4}[^\W\d_]+)?)\s{1,4}$", re.I)
_PLACEHOLDER = re.compile(r"\[[A-ZА-Я_]+(?:_\d+)?\]|\*{2,}")


@lru_cache(1)
def lexicon() -> tuple[frozenset[str], frozenset[str], ahocorasick.Automaton]:
    """Given names, and the automaton of all anchors. A word's value lists (kind, length, detail)."""
    russian, latin = russian_forms(), latin_names()
    kinds: dict[str, list[tuple[str, int, str]]] = {}

    def add(words, kind, detail=""):
        for w in words:
            kinds.setdefault(w, []).append((kind, len(w), detail))

    add(("@", "собака", "эт", *(f"{b}{gap}at" for b in "([{<" for gap in ("", " "))), "at")
    add((" at ", "\tat ", "\nat "), "at_word")
    add(STREET, "street")
    add(LATIN_STREET, "latin_street")
    for w, k in CUES.items():
        add((w,), "cue", k)
    add(PHONE_CUES, "phone")
    add(SERIES_CUES, "series")
    add(ACCOUNT_CUES, "account")
    add((*russian, *latin, "ович", "евич", "овна", "евна", "ична", "ovich", "evich", "ovna", "evna", *TITLES), "name")
    add((c + "." for c in "абвгдеёжзийклмнопрстуфхцчшщъыьэюяabcdefghijklmnopqrstuvwxyz"), "initial")
    a = ahocorasick.Automaton()
    for w, k in kinds.items():
        a.add_word(w, tuple(k))
    a.make_automaton()
    return russian, latin, a


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks, and for each of its characters the place in `text` (None: the same place)."""
    if text.isascii():
        return text, None
    table, changing, _ = compiled()
    places = None
    if _UNSAFE.search(text) and (changing.search(text) or MARKED.search(text)):
        out: list[str] = []
        places = []
        for i, c in enumerate(text):
            to = table.get(ord(c), c)
            if to is None:
                continue
            if unicodedata.combining(c) and out and len(both := unicodedata.normalize("NFC", out[-1] + c)) == 1:
                out[-1] = both
                continue
            for x in to:
                out.append(x)
                places.append(i)
        text = "".join(out)
    if _BESIDE.search(text):
        text = _MIXED.sub(_one_script, text)
    return text, places


_UNSAFE = re.compile(f"[^{SAFE}]")
#: Letters of two scripts side by side, and words that have such.
_BESIDE = re.compile("(?<=[A-Za-zÀ-ɏ])[Ѐ-ԯͰ-Ͽ]|(?<=[Ѐ-ԯͰ-Ͽ])[A-Za-zÀ-ɏ]|[Ͱ-Ͽ]")
_MIXED = re.compile("(?:[A-Za-zÀ-ɏ]+[Ѐ-ԯͰ-Ͽ]|[Ѐ-ԯͰ-Ͽ]+[A-Za-zÀ-ɏ])[A-Za-zÀ-ɏЀ-ԯͰ-Ͽ]*|[Ͱ-Ͽ]+")


def _one_script(m: re.Match) -> str:
    return canonical_words(m[0], same_length=True)


class Anchors:
    """The places of all anchors of a text, by kind, from one pass of the automaton."""

    def __init__(self, low: str, automaton: ahocorasick.Automaton):
        self.at: list[int] = []
        self.at_word: list[int] = []
        self.street: list[tuple[int, int]] = []
        self.latin_street: list[tuple[int, int]] = []
        self.cue: list[int] = []
        self.cue_kind: list[str] = []
        self.phone: list[int] = []
        self.series: list[int] = []
        self.account: list[int] = []
        self.name: list[int] = []
        self.initial: list[int] = []
        for end, found in automaton.iter(low):
            for kind, size, detail in found:
                start = end + 1 - size
                if kind == "initial":
                    if not start or not low[start - 1].isalnum():
                        self.initial.append(start)
                elif kind == "name":
                    self.name.append(end)
                elif kind in ("street", "latin_street"):
                    # Whole words only.
                    if (not start or not (low[start - 1].isalnum() or low[start - 1] in "_-")) and (end + 1 >= len(low) or not (low[end + 1].isalnum() or low[end + 1] in "_-")):
                        getattr(self, kind).append((start, end + 1))
                elif kind == "cue":
                    # Hits come by their ends; cues are compared by where they start, which differs little.
                    self.cue.append(start)
                    self.cue_kind.append(detail)
                else:
                    getattr(self, kind).append(start)
        if any(a > b for a, b in zip(self.cue, self.cue[1:])):
            both = sorted(zip(self.cue, self.cue_kind))
            self.cue, self.cue_kind = [x for x, _ in both], [x for _, x in both]
        self.taxed = "inn" in self.cue_kind
        self.phone.sort()
        self.account.sort()

    def cue_before(self, low: str, start: int) -> str | None:
        """The kind of the cue nearest on the left; digits between cue and number break the tie."""
        k = bisect_left(self.cue, start) - 1
        if k < 0 or self.cue[k] < start - REACH or _THREE.search(low, self.cue[k], start):
            return None
        return self.cue_kind[k]

    def phone_before(self, start: int) -> bool:
        k = bisect_left(self.phone, start) - 1
        return k >= 0 and self.phone[k] >= start - PHONE_REACH

    def account_before(self, start: int) -> bool:
        k = bisect_left(self.account, start) - 1
        return k >= 0 and self.account[k] >= start - PHONE_REACH


_THREE = re.compile(r"\d{3}")


def find(text: str | None, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found, in characters of the text, not overlapping, by place."""
    if not text:
        return []
    look, places = folded(text)
    if places is not None and not places:
        return []
    low = look.lower()
    if len(low) != len(look):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in look)
    russian, latin, automaton = lexicon()
    at = Anchors(low, automaton)
    spans: list[tuple[int, int, str]] = []
    if at.at or at.at_word:
        spans += _emails(look, at)
    if at.street or at.latin_street:
        spans += _addresses(look, at)
    spans += _numbers(look, low, at)
    if at.initial:
        spans += _by_initials(look, low, at.initial)
    if at.name:
        spans += _names(look, low, at.name, russian, latin, spans)
    if not spans:
        return []
    closed = [(*m.span(), "") for m in _PLACEHOLDER.finditer(look)] if "[" in look or "**" in look else []
    taken = _apart(spans, closed)
    if places is not None:
        taken = [(places[s], places[e - 1] + 1, k) for s, e, k in taken]
    return sorted(x for x in taken if x[2] in kinds)


def _apart(spans: list[tuple[int, int, str]], closed: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The finds that overlap no better one: by kind, then length, then place. Taken ones are kept by place, so each
    find is compared with its two neighbours only."""
    ends: list[tuple[int, int, str]] = sorted(closed)
    taken = []
    for s, e, k in sorted(set(spans), key=lambda x: (_RANK[x[2]], x[0] - x[1], x[0])):
        i = bisect_left(ends, (s, e, ""))
        if (i == 0 or ends[i - 1][1] <= s) and (i == len(ends) or ends[i][0] >= e):
            ends.insert(i, (s, e, k))
            taken.append((s, e, k))
    return taken


def _local_start(look: str, end: int) -> int:
    """Where the name of a mailbox that ends here begins; `end` without one."""
    s = end
    while s and _LOCAL.match(look, s - 1):
        s -= 1
    while s < end and not look[s].isalnum():
        s += 1
    return s


def _emails(look: str, at: Anchors) -> Iterator[tuple[int, int, str]]:
    """Mailbox on the left of each at-sign, domain labels and a zone on its right."""
    done = 0
    for hit in at.at:
        sign = hit
        while sign > done and hit - sign < 6 and look[sign - 1] in " \t\n\r([{<":
            sign -= 1
        m = _AT.match(look, sign)
        if not m or m.end() <= hit:
            continue
        start = _local_start(look, sign)
        if start == sign:
            continue
        pos, end = m.end(), 0
        while label := _LABEL.match(look, pos):
            dot = _DOT.match(look, label.end())
            if not dot:
                break
            pos = dot.end()
            zone = _ZONE.match(look, pos)
            end = zone.end() if zone else end
        if end:
            yield start, end, "EMAIL"
            done = end
    for hit in at.at_word:
        sign = hit
        while sign and hit - sign < 4 and look[sign - 1].isspace():
            sign -= 1
        m = _AT_WORD.match(look, sign)
        start = _local_start(look, sign)
        label = m and start < sign and _LOOSE_LABEL.match(look, m.end())
        if not label:
            continue
        end, dots = label.end(), 0
        while (dot := _DOT_WORD.match(look, end)) and (label := _LABEL.match(look, dot.end())):
            end, dots = label.end(), dots + 1
        if dots:
            yield start, end, "EMAIL"


def _addresses(look: str, at: Anchors) -> Iterator[tuple[int, int, str]]:
    """The name and the house beside each kind of street, with what goes with them on both sides."""
    for s, e in at.street:
        m = _STREET_HOUSE.match(look, e)
        if m:
            start = s
        else:
            m = _HOUSE_AFTER.match(look, e)
            name = m and _NAME_BEFORE.search(look, max(0, s - 60), s)
            if not name:
                continue
            start = name.start()
        end = m.end()
        while t := _ADDRESS_TAIL.match(look, end):
            end = t.end()
        head = _ADDRESS_HEAD.search(look, max(0, start - 60), start)
        yield (head.start() if head else start), end, "ADDRESS"
    for s, e in at.latin_street:
        m = _LATIN_BEFORE.search(look, max(0, s - 80), s)
        if m and not any(w in STOP for w in m[1].lower().split()):
            yield m.start(), e, "ADDRESS"


def _runs(look: str) -> Iterator[tuple[int, int]]:
    """Numbers as written: groups of digits with little between them. Groups that touch a letter belong to none."""
    start = end = -1
    for m in _DIGITS.finditer(look):
        a, b = m.span()
        touches = (a > 0 and (look[a - 1].isalpha() or look[a - 1] == "_")) or (b < len(look) and (look[b].isalpha() or look[b] == "_"))
        if start >= 0 and not touches and a - end <= GAP_CHARS and _JOINT.fullmatch(look, end, a):
            end = b
            continue
        if start >= 0:
            yield start, end
            start = -1
        if not touches:
            start, end = a, b
            if start and look[start - 1] == "(":
                start -= 1
            if start and look[start - 1] == "+":
                if start == 1 or not (look[start - 2].isalnum() or look[start - 2] in "_+"):
                    start -= 1
                else:
                    start = -1
            elif start < a and start and (look[start - 1].isalnum() or look[start - 1] == "_"):
                start = a
    if start >= 0:
        yield start, end


def _numbers(look: str, low: str, at: Anchors) -> Iterator[tuple[int, int, str]]:
    for hit in at.series:
        m = _SERIES.match(look, hit) if not hit or not (look[hit - 1].isalnum() or look[hit - 1] == "_") else None
        if m:
            yield m.start(), m.end(), "ID_NUMBER"
    for s, e in _runs(look):
        n = e - s
        if n in (4, 5) and (m := _SIGNED.match(look, s)):
            yield m.start(), m.end(), "ID_NUMBER"
        if n >= 10:
            yield from _split_run(look, low, s, look[s:e], at)


def _split_run(look: str, low: str, start: int, run: str, at: Anchors) -> Iterator[tuple[int, int, str]]:
    kind = financial(run, start, at) or number_kind(run, low, start, start + len(run), at)
    if kind:
        yield start, start + len(run), kind
        return
    # Neighbouring numbers may stand in one run: parted by a tab, a line break or a wide gap, else by any blank.
    for gap in (_WIDE, _BLANK):
        if gap.search(run):
            begin = 0
            pieces = []
            for cut in [*gap.finditer(run), None]:
                end = cut.start() if cut else len(run)
                if end > begin:
                    pieces.append((begin, end))
                begin = cut.end() if cut else end
            if gap is _WIDE:
                for a, b in pieces:
                    if b - a >= 10:
                        yield from _split_run(look, low, start + a, run[a:b], at)
                if any(number_kind(run[a:b], low, start + a, start + b, at) for a, b in pieces):
                    return
            if re.sub(r"\D+", " ", run).split() and [len(x) for x in re.findall(r"\d+", run)] == [4, 4, 4, 4]:
                return
            sizes = [sum(map(str.isdigit, run[a:b])) for a, b in pieces]
            i = 0
            while i < len(pieces):
                # Pieces are joined as long as they hold the digits of one number.
                last, held = i, 0
                while last < len(pieces) and held + sizes[last] <= 15:
                    held += sizes[last]
                    last += 1
                while last > i and held >= 10:
                    a, b = pieces[i][0], pieces[last - 1][1]
                    if b - a >= 10 and (k := number_kind(run[a:b], low, start + a, start + b, at)):
                        yield start + a, start + b, k
                        i = last
                        break
                    last -= 1
                    held -= sizes[last]
                else:
                    i += 1
            return


_WIDE = re.compile(r"[ \t]*[\t\n\r][ \t\n\r]*| {3,}")
_BLANK = re.compile(r"[ \t\n\r]+")


#: A number that is a whole text, line or list item, with its mark.
_ITEM_START = re.compile(r"(?:^|[\n\r;,|]|(?<=\n)\d{1,2}[.)]|^\d{1,2}[.)]|[•*\-–—])[ \t]*$")
#: A run that begins with the mark of a list item.
_MARKED = re.compile(r"\d[.)]\s")
_ITEM_END = re.compile(r"[ \t]*[.;,]?[ \t]*(?:$|[\n\r,;|])")


#: How cards and accounts are grouped, besides not at all.
FINANCIAL_GROUPS = ([4, 4, 4, 4], [4, 4, 4, 4, 3], [4, 6, 5], [6, 10], [5, 3, 1, 4, 7], [4, 4, 4, 4, 4], [5, 3, 12], [3, 2, 3, 1, 4, 7])


def financial(run: str, start: int, at: Anchors) -> str | None:
    """Whether a run is a card or an account: told by its digits, its control digit and its cue."""
    if not 13 <= len(run) <= 32:
        return None
    if run[0] == "+":
        return None
    parts = _DIGITS.findall(run)
    groups, digits = [len(g) for g in parts], "".join(parts)
    if len(groups) > 1 and groups not in FINANCIAL_GROUPS:
        return None
    if len(digits) == 20 and (digits[:3] in ("407", "408", "423", "426") or at.account_before(start)):
        return "ACCOUNT"
    return "CARD" if 13 <= len(digits) <= 19 and len(digits) not in (14, 15, 17) and luhn_valid(digits) else None


def number_kind(run: str, low: str, start: int, end: int, at: Anchors) -> str | None:
    digits = re.sub(r"\D", "", run)
    n = len(digits)
    if n < 10 or n > 15:
        return None
    groups = [len(g) for g in re.findall(r"\d+", run)]
    alone = bool(_ITEM_START.search(low[max(0, start - 12) : start] if start > 12 else low[:start])) and bool(_ITEM_END.match(low, end))
    if run[0] == "+":
        return "PHONE" if n == 11 or n <= 13 and digits[0] not in "17" else None
    cue = at.cue_before(low, start)
    if cue == "inn" and n in (10, 12):
        return "ID_NUMBER"
    if cue == "snils" and n == 11:
        return "ID_NUMBER"
    if cue == "passport" and n == 10 and groups in ([10], [4, 6], [2, 2, 6], [4, 3, 3], [2, 8]):
        return "ID_NUMBER"
    if n == 11:
        if groups == [3, 3, 3, 2]:
            return "ID_NUMBER"
        if groups in ([5, 3, 3], [5, 6]) and digits[0] == "0":
            return "PHONE"
        if digits[0] in "78" and groups in ([11], [1, 10], [1, 3, 7], [1, 3, 3, 4], [1, 3, 3, 2, 2], [1, 3, 2, 2, 3], [4, 3, 2, 2], [4, 7], [4, 3, 4]) and digits[1:4] != "800":
            return "PHONE"
        # Any other grouping needs a phone cue, or the number for itself with an area code's first digit.
        if digits[0] in "78" and digits[1:4] != "800" and len(groups) > 1 and not _MARKED.match(run) and (alone and digits[1] in "3489" or at.phone_before(start)):
            return "PHONE"
        if groups == [11] and digits[0] not in "78" and snils_valid(digits):
            return "ID_NUMBER"
        return "ID_NUMBER" if alone and groups == [11] else None
    if n == 10:
        if groups in ([3, 3, 2, 2], [3, 3, 4], [3, 7]) and ("(" in run or at.phone_before(start) or alone):
            return "PHONE"
        if groups in ([4, 6], [2, 2, 6]) and "." not in run and "/" not in run:
            return "ID_NUMBER"
        if groups == [10] and (alone or inn_valid(digits) and at.taxed):
            return "ID_NUMBER"
        return None
    if n == 12 and groups in ([12], [4, 4, 4]):
        return "ID_NUMBER" if inn_valid(digits) or alone else None
    return None


def _by_initials(look: str, low: str, initials: list[int]) -> Iterator[tuple[int, int, str]]:
    """Initials with the surname right before or right behind them."""
    done = 0
    for p in initials:
        if p < done:
            continue
        m = _INITIALS_HERE.match(look, p)
        if not m:
            continue
        before = _SURNAME_BEFORE.search(look, max(done, p - 84), p)
        if before:
            start, end, word = before.start(), m.end(), before[1]
            done = end
            if (after := _AFTER.match(look, end)) and _SURNAME_END.search(after[1]) and not _SURNAME_END.search(word[:-2] + "x"):
                # A word before the initials, a surname behind them: the surname is the one behind.
                yield p, after.end(), "NAME"
                continue
        elif not p or not (look[p - 1].isalnum() or look[p - 1] in "_./№"):
            after = _SURNAME_AFTER.match(look, m.end())
            if not after:
                continue
            start, end, word = p, after.end(), after[1]
            done = end
        else:
            continue
        dots = m[0]
        if len(dots.replace(" ", "")) < 4 and _ADJECTIVE.search(word):
            continue
        if not (_SURNAME_END.search(word) or _LATIN_SURNAME_END.search(word)) or _STREET_BEFORE.search(low[max(0, start - 16) : start]):
            continue
        if dots[0].islower():
            if word[0].isupper() and not word.isupper() or dots.replace(" ", "").lower() in ("т.д.", "т.е.", "т.п.", "т.к.", "и.о.", "с.г."):
                continue
        elif not word[0].isupper():
            continue
        yield start, end, "NAME"


def _names(look: str, low: str, named: list[int], russian: frozenset[str], latin: frozenset[str], spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    closed = sorted((s, e) for s, e, k in spans if k in ("EMAIL", "ADDRESS"))
    words: list[tuple[int, int]] | None = None
    last = -1
    for end in named:
        if words is None:
            words = [m.span() for m in _NAME_WORD.finditer(low)]
        k = bisect_right(words, (end, len(low) + 1)) - 1
        if k < 0 or k == last or words[k][1] <= end:
            continue
        last = k
        s, e = words[k]
        j = bisect_right(closed, (e, -1)) - 1
        if j >= 0 and closed[j][1] > s:
            continue
        w = low[s:e]
        given = w in russian or w in latin
        father = bool(_PATRONYMIC.match(w) or _LATIN_PATRONYMIC.match(w))
        title = w in TITLES
        if not (given or father or title) or end >= e:
            continue
        got = _around(look, low, words, k, given, father, title, russian, latin)
        if got and not _STREET_BEFORE.search(low[max(0, got[0] - 16) : got[0]]):
            yield got[0], got[1], "NAME"


def _near(look: str, a: int, b: int, comma: bool = False) -> bool:
    gap = look[a:b]
    if comma:
        return gap.strip() == "," and len(gap) <= 3
    return gap != "" and gap.strip(" \t\n\r>") == "" and gap.count("\n") <= 1 and len(gap) <= 6


def _around(look, low, words, k, given, father, title, russian, latin) -> tuple[int, int] | None:
    """The name around word k, if its neighbours make it one."""
    s, e = words[k]
    word = look[s:e]
    left = words[k - 1] if k and _near(look, words[k - 1][1], s) else None
    right = words[k + 1] if k + 1 < len(words) and _near(look, e, words[k + 1][0]) else None

    def text(x):
        w = look[x[0] : x[1]] if x else ""
        return w.swapcase() if w[:1].islower() and w[1:].isupper() else w

    word = text((s, e))

    if title:
        if right and (text(right)[:1].isupper() or low[s:e] in ("mr", "mrs", "ms")) and w_ok(text(right)):
            return s, right[1]
        dotted = words[k + 1] if k + 1 < len(words) else None
        if dotted and look[e : dotted[0]] in (". ", ".") and text(dotted)[:1].isupper() and w_ok(text(dotted)):
            return s, dotted[1]
        return None
    if father:
        if left:
            l = text(left)
            if l.lower() in russian or l.lower() in latin or (l[:1].isupper() and word[0].isupper() and len(l) > 2):
                far = words[k - 2] if k > 1 and _near(look, words[k - 2][1], left[0]) and _family(text(words[k - 2]), word) else None
                tail = right if right and _family(text(right), word) else None
                return (far or left)[0], (tail or (s, e))[1]
        return None
    small = word.islower()
    if small and low[s:e] in COMMON:
        # An ordinary word in small letters: only a patronymic beside it, or a surname before it, makes it a name.
        return None
    if right and (_PATRONYMIC.match(text(right)) or _LATIN_PATRONYMIC.match(text(right))):
        return s, right[1]
    sides = [x for x in (left, right) if x and _family(text(x), word)]
    if len(sides) == 2 and not (_SURNAME_END.search(text(left)) or _LATIN_SURNAME_END.search(text(left))):
        sides = [right]
    if sides:
        return min(s, sides[0][0]), max(e, sides[0][1])
    # Given name, initial, surname; surname, comma, given name (in Latin letters).
    if low[s:e] in latin:
        m = _MIDDLE.match(look, e)
        if m and (m[1][0].isupper() or small):
            return s, m.end()
        if k and _near(look, words[k - 1][1], s, comma=True):
            l = text(words[k - 1])
            if (l[:1].isupper() and word[0].isupper() or small and l.islower() and len(l) > 3) and w_ok(l) and not look[max(0, words[k - 1][0] - 2) : words[k - 1][0]].strip().isalnum():
                before = words[k - 2] if k > 1 else None
                if not before or not _near(look, before[1], words[k - 1][0]) or not small and not text(before)[:1].isupper():
                    return words[k - 1][0], e
    return None


_MIDDLE = re.compile(r"\s[A-Za-z]\.\s([^\W\d_]{3,}(?:-[^\W\d_]+)*)")


def w_ok(word: str) -> bool:
    return len(word) > 2 and word.lower() not in STOP


def _family(word: str, given: str) -> bool:
    """Whether a word beside a given name can be the surname that goes with it."""
    if len(word) < 3 or word.lower() in STOP:
        return False
    cyr = "а" <= word[0].lower() <= "ё"
    if cyr != ("а" <= given[0].lower() <= "ё"):
        return False
    if cyr:
        if _PATRONYMIC.match(word) or not _SURNAME_END.search(word):
            return False
        return given.islower() == word.islower() or given.isupper() == word.isupper() and word[0].isupper()
    if given[0].isupper():
        return word[0].isupper() and (given.isupper() == word.isupper() or "-" in word or not given.isupper() and len(word) > 2 and not word.isupper())
    return word.islower() and (bool(_LATIN_SURNAME_END.search(word)) or given not in COMMON)


def kinds_of(text: str | None) -> list[str]:
    return sorted({k for _, _, k in find(text)})


def replaced(text: str | None, kinds: tuple[str, ...] = KINDS) -> tuple[str | None, int]:
    """The text with each find replaced by its kind in square brackets, and how many were replaced."""
    if not text:
        return text, 0
    found = find(text, kinds)
    out, at = [], 0
    for s, e, k in found:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join(out) + text[at:], len(found)


def redact(text: str | None, kinds: tuple[str, ...] = KINDS) -> str | None:
    return replaced(text, kinds)[0]


def found_kinds(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """row_id, pii_type: one row for each kind that a text holds at least once. No shuffle."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k in kinds_of(t):
                    rows.append(i)
                    kinds.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())], names=["row_id", "pii_type"])

    return spread(df.where(F.col(text) != "").select(row_id, text)).mapInArrow(run, f"row_id {kind}, pii_type string")


def redacted(df: DataFrame, row_id: str, text: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """row_id, text with placeholders, and how many were put in; one row for each row of `df`."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                done, n = replaced(t, kinds)
                texts.append(done)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["row_id", "redacted", "n_found"])

    return spread(df.select(row_id, text)).mapInArrow(run, f"row_id {kind}, redacted string, n_found int")

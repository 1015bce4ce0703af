"""Findings among numbers: phones, cards, pension and tax numbers, licences, passports, codes.

Each number of a text is classified by its shape, by the anchors in the window around it and by contrary signs in its
sentence, first rule first. Rules are plain Python over windows of bounded size, run inside the one Arrow call that
reads a text: as lambdas over arrays the same rules are interpreted by the JVM and cost many times as much.
"""

from __future__ import annotations

from collections.abc import Iterator

from spanveil.functions.validators import inn_valid, luhn_valid, snils_valid
from spanveil.operators.scan import LETTERS, Look, Run, any_in, groups_of
from spanveil.schema import ANCHORED, HIGH, MEDIUM

Found = Iterator[tuple[int, int, str, float, str]]

# Anchors, in lower case.
PASSPORT_CORE = ("паспорт", "серия", "серии", "passport")
PASSPORT = ("пасп", "сери", "номер", "№", "выдан", "удостоверение личности", "паспортные данные", "данные документа", "документ", *PASSPORT_CORE)
PASSPORT_STRICT = ("пасп.", "пасп ", "основной документ", "данные документа", "документ: паспорт", *PASSPORT_CORE)
INN = ("инн", "налогоплательщик", "идентификационный номер")
CARD = ("карт", "card", "pan", "visa", "mastercard", "мир", "maestro", "счёт карты", "номер карты")
PHONE = ("тел", "телефон", "моб", "сот", "звонить", "whatsapp", "вайбер", "номер телефона", "связь", "phone")
POSTCODE = ("индекс", "почтовый индекс", "почтовый код", "индекс получателя", "индекс адреса", "индекс отправления", "индекс по прописке", "zip", "postcode")
SNILS = ("снилс", "страховой номер", "лицевого счета", "лицевого счёта")
DRIVER = ("водительск", "в/у", "ву ", "права", "driver")
CVV = ("cvv", "cvc", "cvv2", "cvc2", "код безопасности", "защитный код", "три цифры", "с обратной стороны", "с оборота", "оборотн", "проверочный код карты", "проверочного кода карты")
PIN = ("пин", "pin", "пин-код", "пинкод", "pin-code", "код доступа к карте", "секретный код карты", "секретный код")
DEPT_WIDE = ("код подразделения", "код органа выдачи", "номер подразделения выдачи", "подразделение", "подразделени")
DEPT = ("код подр", "к/п", "к\\п", "кп:", "кп", "код п/п", "наименование органа выдачи", "орган выдачи", *DEPT_WIDE)
ADDRESS_LEAD = ("адрес", "адресу", "проживает", "прописк", "доставки")
ADDRESS_WORD = ("адрес", "проживает", "прописк", "улица", "ул.", "бульвар", "проспект", "переул", "шоссе", "набережн", "наб.", "микрорайон", "мкр", "квартал", "корп", "стр.", "кв.", "д. ")
MONEY = ("сумма", "руб", "₽", "оплат", "стоимость", "баланс", "остаток", "счёт на", "счет на")
SERVICE = ("заказ", "договор", "накладн", "счёт-фактур", "счет-фактур", "артикул", "заявк", "обращени", "тикет", "операци", "чеке", "транзакци", "огрн", "кпп", "бик", "р/с", "к/с", "расчётный счёт", "расчетный счет", "корреспондентск")
STRONG = ("пасп", "снилс", "инн", "карт", "подразделени", "к/п", "индекс", "телефон", "удостоверен", "водительск", *PASSPORT_CORE)
NOT_PASSPORT = ("инн", "огрн", "кпп", "бик", "лицевой счёт", "лицевой счет", "договор", "полис")
OTHER_DOCUMENT = ("студенческ", "зачётк", "зачетк", "читательск", "абонемент", "пропуск", "табельн")
TYPO_DEPT = ("подразделения", "подразделение", "подразделением", "подразделений")
TYPO_PASSPORT = ("паспорт", "паспорта", "паспорте", "паспортные", "паспортный")
TYPO_PHONE = ("телефон", "телефона", "телефону")
#: Windows in code points: around a value, right before it, the tail of an address, the sentence before it, the text right
#: of a tax number.
AROUND, NEAR, TAIL, SENTENCE, RIGHT = 40, 24, 70, 60, 24
# Words and signs that may stand between the parts of one number.
CONNECTORS = ("номер", "ном", "no", "n", "серия", "сери", "сер", "№", "#", ":", ",", "-", "/", ".", "с", "н", " ")
# Groups of digits that a date begins a number with (one group is a year), and those of a passport.
DATE_GROUPS = ((4, 2, 2), (2, 2, 4), (2, 2, 2), (4,), (2, 1, 4), (1, 2, 4), (1, 1, 4))
PASSPORT_GROUPS = ((4, 6), (2, 2, 6), (10,))
MAX_DOTTED = 12


class Number:
    """One number with its windows, each looked at only when a rule asks."""

    __slots__ = ("look", "run", "digits", "n", "pattern", "_at", "_service", "_money")

    def __init__(self, look: Look, run: Run):
        self.look, self.run, self.digits, self.n = look, run, run.digits, len(run.digits)
        self.pattern = "-".join(map(str, run.groups))
        self._at: dict[int, bool] = {}
        self._service = self._money = None

    def at(self, words: tuple[str, ...]) -> bool:
        """An anchor in the window around."""
        got = self._at.get(id(words))
        if got is None:
            got = self._at[id(words)] = self.look.has(self.run.start, self.run.end, words, AROUND, AROUND // 2)
        return got

    def near(self, words: tuple[str, ...], reach: int = NEAR) -> bool:
        return self.look.before(self.run.start, words, reach)

    def after(self, words: tuple[str, ...]) -> bool:
        return self.look.has(self.run.end, self.run.end, words, 0, NEAR)

    def typo(self, words: tuple[str, ...]) -> bool:
        return self.look.typo(self.run.start, self.run.end, words, AROUND, AROUND // 2)

    def typo_left(self, words: tuple[str, ...], least: int = 7) -> bool:
        return self.look.typo(self.run.start, self.run.start, words, NEAR, 0, least)

    @property
    def money(self) -> bool:
        if self._money is None:
            self._money = any_in(self.look.low[max(0, self.run.start - AROUND) : self.run.end + 10], MONEY)
        return self._money

    @property
    def service(self) -> bool:
        if self._service is None:
            self._service = is_service(self.look, self.run.start)
        return self._service

    @property
    def head(self) -> str:
        return self.look.head(self.run.start, SENTENCE)


def is_service(look: Look, start: int) -> bool:
    """Whether the sentence before names a number of an organisation, with no personal word in between and no passport
    close by."""
    head = look.head(start, SENTENCE)
    last = max((at + len(w) for w in SERVICE if (at := head.rfind(w)) >= 0), default=-1)
    if last < 0 or any_in(head[last:], STRONG):
        return False
    return not any_in(look.low[max(0, start - SENTENCE) : start], PASSPORT_STRICT)


def phone(x: Number):
    d = x.digits
    if not (x.run.plus and 10 <= x.n <= 15 or x.n == 11 and d[0] in "78" or x.n == 10 and len(x.run.groups) >= 3):
        return None
    if x.n == 11 and d[0] in "78" and d[1:4] in ("800", "803", "804"):
        return None
    if x.at(PHONE):
        return "PHONE", HIGH, "phone:anchor"
    if x.run.plus or d[0] in "78":
        return "PHONE", HIGH, "phone:shape"
    return ("PHONE", HIGH, "phone:anchor_typo") if x.typo(TYPO_PHONE) else None


def card(x: Number):
    if not 13 <= x.n <= 19:
        return None
    good = luhn_valid(x.digits)
    if x.at(CARD):
        return "CARD", HIGH, "card:luhn+anchor" if good else "card:shape+anchor"
    if x.service or x.money:
        return None
    if good:
        return "CARD", HIGH, "card:luhn"
    return ("CARD", MEDIUM, "card:shape") if x.pattern == "4-4-4-4" else None


def snils(x: Number):
    if x.n not in (10, 11, 12):
        return None
    if x.at(SNILS):
        return ("SNILS", HIGH, "snils:anchor") if x.n == 11 else ("SNILS", ANCHORED, "snils:anchor_typo_digits")
    return ("SNILS", ANCHORED, "snils:checksum") if x.pattern == "3-3-3-2" and snils_valid(x.digits) else None


def inn(x: Number):
    if not 10 <= x.n <= 13:
        return None
    anchored = x.at(INN)
    if x.n in (11, 13):
        return ("INN", ANCHORED, "inn:anchor_typo_digits") if anchored else None
    if anchored:
        right = x.look.low[x.run.end : x.run.end + RIGHT]
        stop = min((k for k in map(right.find, ".!?\n\r") if k >= 0), default=len(right))
        return None if x.n == 10 and "кпп" in right[:stop] else ("INN", ANCHORED, "inn:anchor")
    if x.pattern in ("4-6", "2-2-6") and x.at(PASSPORT):
        return None
    return ("INN", MEDIUM, "inn:checksum") if inn_valid(x.digits) and not x.money and not x.service else None


def driver(x: Number):
    return ("DRIVER_LICENSE", HIGH, "driver:anchor") if x.pattern in ("2-2-6", "10") and x.at(DRIVER) else None


def passport(x: Number):
    if not 9 <= x.n <= 11 or x.service:
        return None
    return (passport_shape(x) if x.pattern in ("4-6", "2-2-6", "10", "4-2-4") else None) or (("PASSPORT", ANCHORED, "passport:anchor_typo_digits") if x.near(PASSPORT_STRICT) else None)


def passport_shape(x: Number):
    if x.at(PASSPORT):
        return None if any_in(x.head, OTHER_DOCUMENT) else ("PASSPORT", HIGH, "passport:anchor")
    if x.typo(TYPO_PASSPORT):
        return "PASSPORT", HIGH, "passport:anchor_typo"
    if any_in(x.head, NOT_PASSPORT) or any_in(x.head, OTHER_DOCUMENT):
        return None
    if x.pattern in ("4-6", "2-2-6"):
        return "PASSPORT", ANCHORED, "passport:shape"
    if x.pattern == "10" and not x.money and LETTERS.search(x.look.low, max(0, x.run.start - AROUND), x.run.end + AROUND // 2):
        return "PASSPORT", ANCHORED, "passport:shape_solid"
    return None


def department(x: Number):
    """Three and three digits, alone or as the first or last part of a longer number; six or five digits."""
    g = x.run.groups
    first = (0, 1) if g[:2] == (3, 3) else None
    last = next(((i - 1, i) for i in range(len(g) - 1, 0, -1) if g[i - 1] == g[i] == 3), None) if len(g) > 1 else None
    if last is None and len(g) > 1:
        last = next(((i, i) for i in range(len(g) - 1, -1, -1) if g[i] == 6), None)
    if not (x.pattern in ("3-3", "6") or x.n in (5, 6) or first or last):
        return None
    if x.near(DEPT):
        conf, reason, part = HIGH, "dept:anchor", first
    elif x.near(DEPT_WIDE, AROUND):
        conf, reason, part = HIGH, "dept:anchor_wide", first
    elif x.after(DEPT):
        conf, reason, part = HIGH, "dept:anchor_after", last
    elif x.typo_left(TYPO_DEPT):
        conf, reason, part = HIGH, "dept:anchor_typo", first
    elif x.pattern == "3-3" and (x.at(PASSPORT) or short_passport(x.look.low[max(0, x.run.start - AROUND) : x.run.end + AROUND])):
        conf, reason, part = ANCHORED, "dept:passport_context", first
    else:
        return None
    if not part:
        return "DEPT_CODE", conf, reason
    places = groups_of(x.look, x.run)
    return "DEPT_CODE", conf, reason, places[part[0]][0], places[part[1]][1]


def short_passport(window: str) -> bool:
    """Series and number around a number sign, or behind the one-letter abbreviations of both."""
    at = window.find("№")
    if at >= 0 and window[:at].rstrip(" \t")[-4:].isdigit() and len(window[:at].rstrip(" \t")) >= 4:
        number = window[at + 1 :].lstrip(" \t")[:6]
        if len(number) == 6 and number.isdigit():
            return True
    at = window.find("с.")
    if at < 0:
        return False
    series, _, number = window[at + 2 :].lstrip(" \t").partition("н.")
    number = number.lstrip(" \t")[:6]
    return len(series.rstrip(" \t")) == 4 and series.rstrip(" \t").isdigit() and len(number) == 6 and number.isdigit()


def postcode(x: Number):
    if x.n != 6:
        return None
    if x.near(POSTCODE) or x.after(POSTCODE):
        return "POSTCODE", HIGH, "postcode:anchor"
    if x.near(ADDRESS_LEAD):
        return "POSTCODE", ANCHORED, "postcode:address_lead"
    left = x.look.low[max(0, x.run.start - TAIL) : x.run.start]
    left = left[max(left.rfind("\n"), left.rfind("\r")) + 1 :]
    if left.rstrip(" \t").endswith(",") and any_in(left, ADDRESS_WORD):
        return "POSTCODE", ANCHORED, "postcode:address_tail"
    return ("POSTCODE", ANCHORED, "postcode:anchor_typo") if x.typo_left(POSTCODE, 6) else None


def secret(x: Number):
    if not 2 <= x.n <= 5:
        return None
    if x.near(PIN) or x.after(PIN):
        return "PIN", HIGH, "pin:anchor"
    if x.n < 3:
        return None
    if x.near(CVV) or x.after(CVV):
        return "CVV", HIGH, "cvv:anchor"
    if x.typo_left(CVV, 5):
        return "CVV", ANCHORED, "cvv:anchor_typo"
    return ("PIN", ANCHORED, "pin:anchor_typo") if x.typo_left(PIN, 3) else None


#: First rule first.
RULES = (phone, card, snils, inn, driver, passport, department, postcode, secret)


def single(look: Look, run: Run) -> tuple[int, int, str, float, str] | None:
    """What one number is, by itself."""
    if len(run.digits) < 2 or len(run.groups) >= 4 and run.seps == "." and len(run.digits) <= MAX_DOTTED:
        return None
    x = Number(look, run)
    for rule in RULES:
        got = rule(x)
        if got:
            kind, conf, reason, *ends = got
            return (*(ends or (run.start, run.end)), kind, conf, reason)
    return None


def singles(look: Look) -> Found:
    """Every number by itself, as if none belonged together."""
    for run in look.runs:
        got = single(look, run)
        if got:
            yield got


def numbers(look: Look) -> Found:
    """All numbers: passports written in parts and codes written in pairs are joined, passports glued to a date are cut."""
    runs, taken = look.runs, -1
    for i, run in enumerate(runs):
        if i <= taken:
            continue
        if 2 <= len(run.digits) <= 4 and (last := passport_parts(look, i)) is not None:
            yield run.start, runs[last].end, "PASSPORT", HIGH, "passport:series_number_words"
            taken = last
            continue
        glued = list(after_date(look, run))
        if glued:
            yield from glued
            continue
        got = single(look, run)
        if not got:
            continue
        yield got
        if got[2] == "PIN" and len(run.digits) == 2 and i + 1 < len(runs) and len(runs[i + 1].digits) == 2 and connected(look.low[run.end : runs[i + 1].start], 8):
            yield runs[i + 1].start, runs[i + 1].end, "PIN", HIGH, "pin:split_pair"
            taken = i + 1


def connected(gap: str, longest: int) -> bool:
    """Whether nothing but connecting words and signs stands between two numbers."""
    if len(gap) > longest:
        return False
    for w in CONNECTORS:
        gap = gap.replace(w, " ")
    return not gap.strip()


def digits_from(look: Look, i: int, wanted: int) -> int | None:
    """The last of at most two numbers from i on that have so many digits together."""
    runs = look.runs
    have = len(runs[i].digits)
    if have == wanted:
        return i
    if have < wanted and i + 1 < len(runs):
        gap = look.low[runs[i].end : runs[i + 1].start]
        if "." not in gap and connected(gap, 3) and have + len(runs[i + 1].digits) == wanted:
            return i + 1
    return None


def passport_parts(look: Look, i: int) -> int | None:
    """The last number of a passport whose series begins with number i, with words between series and number."""
    runs = look.runs
    if i + 1 >= len(runs):
        return None
    series = digits_from(look, i, 4)
    if series is None or is_service(look, runs[i].start):
        return None
    left = look.low[max(0, runs[i].start - 8) : runs[i].start].rstrip(" \t")
    short = left.endswith("с.") and not left[-3:-2].isalpha()
    if not short and not look.has(runs[i].start, runs[series].end, PASSPORT, AROUND, AROUND):
        return None
    for j in (series + 1, series + 2):
        if j >= len(runs):
            return None
        gap = look.low[runs[series].end : runs[j].start]
        if "\n" in gap or "\r" in gap or not connected(gap, 24):
            return None
        last = digits_from(look, j, 6)
        if last is not None:
            return last
    return None


def after_date(look: Look, run: Run) -> Found:
    """The passport behind a date in one number; in two parts where a number sign stands between them."""
    if len(run.groups) < 3:
        return
    for date in DATE_GROUPS:
        if run.groups[: len(date)] == date and run.groups[len(date) :] in PASSPORT_GROUPS:
            break
    else:
        return
    places = groups_of(look, run)
    if len(date) == 1 and look.text[places[0][0] : places[0][0] + 2] not in ("19", "20"):
        return
    rest = places[len(date) :]
    begin = 0
    for k in range(1, len(rest) + 1):
        if k < len(rest) and not any(c in "№#" for c in look.text[rest[k - 1][1] : rest[k][0]]):
            continue
        yield rest[begin][0], rest[k - 1][1], "PASSPORT", ANCHORED, "passport:after_date"
        begin = k

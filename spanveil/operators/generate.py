"""A labelled synthetic corpus: each row depends on its number and the seed only, so any executor makes the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanveil.functions import validators as v
from spanveil.functions.names import FEMALE, MALE, translit
from spanveil.operators.synthetic import Draw, fnv64

SURNAMES = ["Лугов", "Ветров", "Громов", "Полевой", "Соснин", "Ручьёв", "Зимин", "Кедров"]
STREETS = ["Тихая", "Речная", "Садовая", "Новая", "Озёрная", "Лесная"]
CITIES = ["Светлоград", "Заполье", "Луговое", "Тихоборск"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
SPAN = pa.list_(pa.struct([("start_byte", pa.int32()), ("end_byte", pa.int32()), ("type", pa.string())]))


def _n(d: Draw, k: int) -> str:
    return "".join(str(d.below(10)) for _ in range(k))


def person(d: Draw) -> str:
    female = d.below(2)
    surname = SURNAMES[d.below(len(SURNAMES))]
    if female:
        surname = surname[:-2] + "ая" if surname.endswith("ой") else surname + "а"
    given = (FEMALE if female else MALE)[d.below(60)].capitalize()
    father = ["Иванов", "Петров", "Олегов", "Андреев"][d.below(4)] + ("на" if female else "ич")
    return [f"{surname} {given} {father}", f"{given} {surname}", f"{surname} {given[0]}. {father[0]}."][d.below(3)]


def date(d: Draw) -> str:
    day, month, year = 1 + d.below(28), 1 + d.below(12), 1950 + d.below(55)
    return [f"{day:02}.{month:02}.{year}", f"{day} {MONTHS[month - 1]} {year} года", f"{year}-{month:02}-{day:02}"][d.below(3)]


def card(d: Draw) -> str:
    body = "4" + _n(d, 14)
    full = body + next(str(c) for c in range(10) if v.luhn_valid(body + str(c)))
    return full if d.below(2) else " ".join(full[i : i + 4] for i in range(0, 16, 4))


def inn(d: Draw) -> str:
    body = _n(d, 10)
    body += v._control(body, v.INN12A)
    return body + v._control(body, v.INN12B)


def snils(d: Draw) -> str:
    body = _n(d, 9)
    return f"{body[:3]}-{body[3:6]}-{body[6:]} {sum(int(c) * (9 - i) for i, c in enumerate(body)) % 101 % 100:02}"


def phone(d: Draw) -> str:
    a, b = _n(d, 3), _n(d, 7)
    return [f"+7 {a} {b[:3]}-{b[3:5]}-{b[5:]}", f"8({a}){b}", f"8{a}{b}"][d.below(3)]


#: Makers of values by type, each with the anchor it is written after.
MAKERS = {
    "FIO": (person, "Клиент"), "DOB": (date, "дата рождения"), "PASSPORT": (lambda d: f"{_n(d, 4)} {_n(d, 6)}", "паспорт"), "CARD": (card, "карта"), "INN": (inn, "ИНН"),
    "SNILS": (snils, "СНИЛС"), "PHONE": (phone, "телефон"), "EMAIL": (lambda d: f"{translit(MALE[d.below(60)])}{_n(d, 3)}@example.com", "почта"),
    "ADDRESS": (lambda d: f"г. {CITIES[d.below(4)]}, ул. {STREETS[d.below(6)]}, д. {1 + d.below(99)}, кв. {1 + d.below(200)}", "адрес"), "DEPT_CODE": (lambda d: f"{_n(d, 3)}-{_n(d, 3)}", "код подразделения"),
    "POSTCODE": (lambda d: str(1 + d.below(8)) + _n(d, 5), "индекс"), "PIN": (lambda d: _n(d, 4), "пин-код"), "CVV": (lambda d: _n(d, 3), "cvv"), "CITIZENSHIP": (lambda d: ["Россия", "Казахстан"][d.below(2)], "гражданство"),
    "BIRTH_PLACE": (lambda d: f"г. {CITIES[d.below(4)]}", "место рождения"), "ISSUER": (lambda d: f"ОВД района {STREETS[d.below(6)]}", "кем выдан"),
    "ISSUE_DATE": (date, "дата выдачи"), "ACCOUNT": (lambda d: "40817" + _n(d, 15), "счёт"), "PLATE": (lambda d: f"А{_n(d, 3)}ВС {_n(d, 2)}", "госномер"), "OMS": (lambda d: _n(d, 16), "полис ОМС"),
    "VIN": (lambda d: "XTA" + _n(d, 14), "vin"), "IP_ADDRESS": (lambda d: f"10.{d.below(250)}.{d.below(250)}.{1 + d.below(250)}", "ip"), "DRIVER_LICENSE": (lambda d: f"{_n(d, 2)} АВ {_n(d, 6)}", "водительское"),
    "CARDHOLDER": (lambda d: f"{translit(MALE[d.below(60)])} {translit(SURNAMES[d.below(8)].lower())}".upper(), "держатель карты"), "MILITARY_ID": (lambda d: f"АВ {_n(d, 7)}", "военный билет"),
    "BIRTH_CERT": (lambda d: f"IV-МЮ {_n(d, 6)}", "свидетельство о рождении"), "FOREIGN_PASSPORT": (lambda d: f"{_n(d, 2)} {_n(d, 7)}", "загранпаспорт"), "RESIDENCE_PERMIT": (lambda d: _n(d, 9), "вид на жительство"),
}
#: How a value is written beside its anchor.
SHAPES = (
    "{a}: {v}", "{a} {v}", "{a} — {v}", "{a} - {v}", "{a} = {v}", "{a}={v}", "{a} ({v})", "{a} [{v}]", "{a}: «{v}»", '{a}: "{v}"', "{a}:\n{v}", "{a} | {v} |", "• {a}: {v}", "1) {a}: {v}",
    "{a}:\u00a0{v}", "{a}  {v}", "{a}\t{v}", "{a}: {v};", "«{v}» ({a})", "{v} — {a}",
)
# What negative texts are made of; {n} is a number of five digits, {m} one of three.
NEGATIVES = {
    "neg_order": "Заказ {n} передан в доставку.", "neg_money": "Сумма {n} руб. списана.", "neg_org": "ООО «Ветер», ОГРН {n}.", "neg_vehicle": "Партия {n} отгружена.",
    "neg_plain": "Спасибо за помощь, вопрос решён.", "neg_article": "Артикул {n}, остаток мал.", "neg_version": "Версия 1.{m}.0 вышла.", "neg_meeting": "Встреча в {m} кабинете.",
    "neg_ticket": "Тикет {n} закрыт.", "neg_invoice": "Счёт-фактура {n} выставлена.", "neg_contract": "Договор {n} вступает в силу.", "neg_tracking": "Накладная {n} оформлена.", "neg_percent": "Рост составил {m} процентов.",
    "neg_page": "Смотрите страницу {m} отчёта.", "neg_shelf": "Стеллаж {m}, ряд {m}.", "neg_room": "Аудитория {m} занята.", "neg_weight": "Вес груза {m} кг.", "neg_length": "Длина трассы {m} км.", "neg_speed": "Скорость {m} км в час.",
    "neg_temperature": "Температура минус {m} не бывает.", "neg_pressure": "Давление {m} мм.", "neg_score": "Набрано {m} баллов.", "neg_queue": "Вы {m} в очереди.", "neg_period": "Срок {m} дней.", "neg_batch": "Серийная партия {n} принята.",
    "neg_error": "Ошибка {m} при входе.", "neg_port": "Порт {n} закрыт.", "neg_hash": "Сборка a{m}f{n}c готова.", "neg_formula": "x = {m} + {n} / 2", "neg_list": "1. хлеб\n2. сыр\n3. чай", "neg_question": "Как изменить тариф?", "neg_greeting": "Добрый день! Чем помочь?",
    "neg_thanks": "Благодарим за обращение, ответим скоро.", "neg_rules": "Правила размещены на сайте.", "neg_weather": "Завтра дождь и ветер.", "neg_recipe": "Варить {m} минут, снять с огня.", "neg_sport": "Матч закончился со счётом 2:1.",
    "neg_film": "Фильм идёт {m} минут.", "neg_street": "На улице было тихо и темно.", "neg_city": "Поезд идёт через два города.", "neg_month": "Отчёт за март готов.", "neg_toll_free": "Горячая линия 8 800 {m} 35 35.", "neg_english": "The meeting moved to room {m}.",
    "neg_code": "if (x > {m}) return {n};", "neg_quote": "«Тише едешь — дальше будешь», — сказал он.", "neg_table": "товар | цена\nчай | {m}\nсыр | {m}",
}


def written(d: Draw, kind: str, shape: str | None = None) -> tuple[str, int, str]:
    """A value of a type beside its anchor, where it begins, and the value."""
    maker, anchor = MAKERS[kind]
    value = maker(d)
    shape = shape or SHAPES[d.below(len(SHAPES))]
    before, _, after = shape.partition("{v}")
    head = before.replace("{a}", anchor)
    return head + value + after.replace("{a}", anchor), len(head), value


class Text:
    """A text under construction with its spans in characters."""

    def __init__(self):
        self.text, self.spans = "", []

    def say(self, words: str) -> None:
        self.text += words

    def put(self, d: Draw, kind: str, shape: str | None = None) -> str:
        part, at, value = written(d, kind, shape)
        self.spans.append((len(self.text) + at, len(self.text) + at + len(value), kind))
        self.text += part
        return value


def _any(d: Draw) -> str:
    return sorted(MAKERS)[d.below(len(MAKERS))]


def _single(d, t):
    t.put(d, _any(d))


def _mixed(d, t):
    for _ in range(2 + d.below(4)):
        t.put(d, _any(d))
        t.say("\n")


def _dialog(d, t):
    t.say("— Добрый день, чем помочь?\n— ")
    t.put(d, _any(d))
    t.say("\n— Спасибо, проверяю. Что-нибудь ещё?\n— ")
    t.put(d, _any(d))
    t.say("\n")


def _statement(d, t):
    t.say("Заявление\nПрошу внести изменения в мои данные.\n")
    for k in ("FIO", "PASSPORT", "ADDRESS"):
        t.put(d, k, "{a}: {v}")
        t.say("\n")


def _export_row(d, t):
    for _ in range(4):
        t.put(d, _any(d), "{a}={v}")
        t.say("; ")


def _table(d, t):
    for _ in range(2 + d.below(3)):
        t.put(d, _any(d), "| {a} | {v} |")
        t.say("\n")


def _letter(d, t):
    t.say("Здравствуйте!\nПишу по поводу заявки, мои данные ниже. ")
    t.put(d, "PHONE", "{a}: {v}")
    t.say(". Жду ответа.\n")
    t.put(d, "EMAIL", "{a}: {v}")


def _note(d, t):
    t.put(d, "FIO", "{a} {v}")
    t.say(" просил перезвонить, ")
    t.put(d, "PHONE", "{a} {v}")


def _two_people(d, t):
    for _ in range(2):
        t.put(d, "FIO", "{a}: {v}")
        t.say(", ")
        t.put(d, "PHONE", "{a}: {v}")
        t.say("\n")


def _three_mentions(d, t):
    value = t.put(d, "FIO", "{a} {v}")
    for words in (" написал нам. ", " ждёт ответа. "):
        t.say(words)
        t.spans.append((len(t.text), len(t.text) + len(value), "FIO"))
        t.say(value)
    t.say(" благодарит.")


def _bilingual(d, t):
    t.say("Dear team, please update the record. Просим обновить запись. ")
    t.put(d, _any(d))


def _long(d, t):
    filler = "Ответ по обращению готовится, срок не изменился. " * (1400 + d.below(200))
    half = len(filler) // 2
    t.say(filler[:half])
    t.put(d, _any(d), " {a}: {v}. ")
    t.say(filler[half:])


#: Kinds of texts by category, with their weights.
KINDS = {
    "single": (_single, 40), "mixed": (_mixed, 15), "dialog": (_dialog, 6), "statement": (_statement, 4), "export_row": (_export_row, 4), "table": (_table, 5), "email_letter": (_letter, 4), "free_note": (_note, 4),
    "two_people": (_two_people, 3), "three_mentions": (_three_mentions, 3), "bilingual": (_bilingual, 3),
}
#: Changes of a finished text that leave its values as they are: share of texts in hundredths.
TYPO, NOISE, LOOK_ALIKE = 3, 3, 2
_ALIKE = str.maketrans("еорс", "eopc")


def _changed(d: Draw, t: Text, change) -> Text:
    """The text with `change` applied between its values, spans moved along."""
    out, at = Text(), 0
    for s, e, k in sorted(t.spans):
        out.say(change(d, t.text[at:s]))
        out.spans.append((len(out.text), len(out.text) + e - s, k))
        out.say(t.text[s:e])
        at = e
    out.say(change(d, t.text[at:]))
    return out


def _typo(d: Draw, words: str) -> str:
    """Two neighbouring letters of the longest word swapped, if it is long enough to be known again."""
    longest = max(words.split(), key=len, default="").strip(":=—-|()")
    if len(longest) < 8:
        return words
    k = 3 + d.below(len(longest) - 5)
    return words.replace(longest, longest[:k] + longest[k + 1] + longest[k] + longest[k + 2 :], 1)


def _noise(d: Draw, words: str) -> str:
    return words.replace(" ", ["  ", " ", "\u00a0", " \t"][d.below(4)])


def sample(i: int, seed: int, lowercase: bool) -> dict:
    """Sample number i: its category, text and spans in bytes."""
    d = Draw(fnv64(f"{seed}|{i}"))
    if d.below(100) < 14:
        name = sorted(NEGATIVES)[d.below(len(NEGATIVES))]
        text = NEGATIVES[name].format(n=_n(d, 5), m=100 + d.below(899))
        return {"id": f"gen-{seed}-{i}", "category": name, "source": "synthetic", "text": text.lower() if lowercase else text, "spans": [], "partial_labels": False}
    t, category = Text(), "long_64k"
    if d.below(2000) == 0:
        _long(d, t)
    else:
        at = d.below(sum(w for _, w in KINDS.values()))
        for category, (make, weight) in KINDS.items():
            if at < weight:
                break
            at -= weight
        make(d, t)
        if category == "single":
            category = t.spans[0][2].lower()
        change = d.below(100)
        if change < TYPO:
            t, category = _changed(d, t, _typo), "typos"
        elif change < TYPO + NOISE:
            t, category = _changed(d, t, _noise), "noise"
        elif change < TYPO + NOISE + LOOK_ALIKE:
            t, category = _changed(d, t, lambda _, w: w.translate(_ALIKE)), "look_alike"
    out = t.text
    spans = [{"start_byte": len(out[:s].encode()), "end_byte": len(out[:e].encode()), "type": k} for s, e, k in sorted(t.spans)]
    if lowercase and len(out.lower().encode()) == len(out.encode()):
        out = out.lower()
    return {"id": f"gen-{seed}-{i}", "category": category, "source": "synthetic", "text": out, "spans": spans, "partial_labels": False}


def generated(spark: SparkSession, n: int, seed: int = 1, lowercase: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sample(i, seed, lowercase) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[k] for r in rows], SPAN if k == "spans" else pa.bool_() if k == "partial_labels" else pa.string()) for k in ("id", "category", "source", "text", "spans", "partial_labels"))],
                names=["n", "id", "category", "source", "text", "spans", "partial_labels"],
            )

    return spark.range(n).withColumnRenamed("id", "n").mapInArrow(run, "n long, id string, category string, source string, text string, spans array<struct<start_byte:int,end_byte:int,type:string>>, partial_labels boolean")

"""Exclusions by context: values a policy allows, network addresses, common words, streets, public figures, company
requisites, reference numbers and company addresses. Each is a predicate over a span and its text; the first reason
stands. All of it is one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions import validators as v

# Stems of contrary signs.
STREET_MARKERS = ["ул", "улиц", "проспект", "пр-т", "пр-кт", "просп", "переул", "пер", "шоссе", "бульвар", "набережн", "площад", "имени", "им."]
ROLE_MARKERS = ["президент", "министр", "губернатор", "мэр", "глава", "председател", "депутат", "писател", "поэт", "композитор", "художник", "актёр", "актер", "режиссёр", "режиссер", "певец", "певиц", "учён", "академик", "император", "царь", "космонавт", "спортсмен", "предпринимател", "основател", "блогер", "телеведущ", "миллиардер", "политик", "бизнесмен"]
QUESTION_MARKERS = ["кто такой", "кто такая", "расскажи о", "расскажи про", "биография", "чем известен", "что сделал", "что думал"]
BANK_MARKERS = ["паспорт", "карт", "счёт", "счет", "кредит", "вклад", "клиент", "заявлени", "телефон", "инн", "снилс"]
REQUISITES = ["огрн", "кпп", "бик", "окпо", "октмо", "р/с", "к/с"]
REFERENCES = ["заказ", "заявк", "накладн", "договор", "обращени", "артикул", "тикет", "чек", "полис", "партия", "трек", "order", "ticket", "invoice"]
PERSONAL = ["паспорт", "снилс", "инн", "карт", "телефон", "тел", "подразделени", "к/п", "индекс", "клиент", "пин", "cvv", "прожива", "зарегистрирован"]
ORGANISATIONS = ["офис", "филиал", "отделени", "банк", "магазин", "склад", "компани", "организаци", "фирм", "завод", "ооо", "оао", "зао", "пао", "ао", "ип"]
COMMON_WORDS = ["банк", "карта", "договор", "заявка", "оператор", "менеджер", "клиент", "вера", "надежда", "любовь", "роза", "слава"]
NUMBERS = ["PASSPORT", "CARD", "INN", "PHONE", "SNILS", "CVV", "PIN", "DEPT_CODE", "DRIVER_LICENSE", "MILITARY_ID", "BIRTH_CERT", "FOREIGN_PASSPORT", "RESIDENCE_PERMIT", "POSTCODE", "ACCOUNT", "OMS", "PLATE", "VIN", "IP_ADDRESS"]
HARMLESS = ["FIO", "BIRTH_PLACE", "CITIZENSHIP"]
#: Windows in code points.
FIGURE, ORGANISATION, STREET, REFERENCE, REQUISITE, CHAIN = 80, 80, 15, 40, 12, 12
LEFT_PENALTY, SENTENCE_PENALTY = 8, 16


@dataclass(frozen=True)
class Exclusions:
    """What a policy lets through. Figures are `surname given` entries; lists are compared by plain form."""

    public_figures: bool = True
    org_addresses: bool = True
    allowed: tuple[str, ...] = ()
    figures: tuple[str, ...] = ()


def _marker(win: Column, stems: list[str], tail: int = 3) -> Column:
    return win.rlike(rf"(?<![\p{{L}}\p{{Nd}}])(?:{t.quoted(stems)})\p{{L}}{{0,{tail}}}(?!\p{{L}})")


def _last(win: Column, stems: list[str]) -> Column:
    """The place of the last marker in a window, -1 without one."""
    found = t.matches(win, rf"(?<![\p{{L}}\p{{Nd}}])(?:{t.quoted(stems)})\p{{L}}{{0,3}}(?!\p{{L}})")
    return F.when(F.size(found) > 0, F.element_at(found, -1)["start"]).otherwise(-1)


def street_before(low: Column, span: Column) -> Column:
    """Whether a kind of street stands right before a span."""
    return _marker(t.cut(low, span["start"] - STREET, span["start"]), STREET_MARKERS)


def common_word(value: Column) -> Column:
    """Whether a value is one ordinary word."""
    return (F.size(t.letter_words(value)) == 1) & t.plain(value).isin(COMMON_WORDS)


def excluded(text: Column, low: Column, spans: Column, rules: Exclusions) -> Column:
    """`spans` with a `why` each: NULL for those that stay."""
    marks = t.matches(low, rf"(?<![\p{{L}}\p{{Nd}}])(?:{t.quoted(ORGANISATIONS)})\p{{L}}{{0,3}}(?!\p{{L}})")
    addresses = F.filter(spans, lambda s: s["type"] == "ADDRESS")

    def distance(a, b):
        return F.greatest(a["start"] - b["end"], b["start"] - a["end"], F.lit(0))

    def sentence_of(place):
        return F.regexp_count(F.substring(text, F.lit(1), place), F.lit(r"\n|[.!?;](?=[ \n])"))

    def score(mark, s):
        return distance(mark, s) + F.when(s["end"] <= mark["start"], LEFT_PENALTY).otherwise(0) + F.when(sentence_of(mark["start"]) != sentence_of(s["start"]), SENTENCE_PENALTY).otherwise(0)

    def nearest(mark):
        near = F.filter(addresses, lambda s: distance(mark, s) <= ORGANISATION)
        ranked = F.array_sort(F.transform(near, lambda s: F.struct(score(mark, s).alias("score"), s["start"].alias("start"))))
        return F.get(ranked, F.lit(0))["start"]

    owned = F.transform(marks, nearest)
    owned_spans = F.filter(addresses, lambda s: F.array_contains(owned, s["start"]) & ~t.contains_any(t.window(low, s["start"], s["end"], 60, 60), PERSONAL))

    def company(s):
        chained = F.exists(owned_spans, lambda o: (distance(o, s) <= CHAIN) & (sentence_of(o["start"]) == sentence_of(s["start"])))
        return F.lit(rules.org_addresses) & (s["type"] == "ADDRESS") & chained

    allowed = F.array(*[F.lit(a) for a in rules.allowed]).cast("array<string>")
    allowed = F.transform(allowed, t.plain)
    figures = F.array(*[F.lit(f) for f in rules.figures]).cast("array<string>")
    figures = F.transform(figures, lambda f: F.array_join(F.array_sort(F.transform(t.letter_words(f), t.stem)), " "))

    def figure(s, value):
        before = F.substring(text, F.lit(1), s["start"])
        # What stands behind the last blank line.
        paragraph_start = F.length(before) - F.length(F.element_at(F.split(before, r"\n[ \t\r]*+\n", -1), -1))
        rest = F.substring(low, paragraph_start + 1, F.length(low))
        paragraph = F.element_at(F.split(rest, r"\n[ \t\r]*\n", 2), 1)
        end = paragraph_start + F.length(paragraph)
        clean = ~_marker(paragraph, BANK_MARKERS) & ~F.exists(spans, lambda o: ~o["type"].isin(HARMLESS) & (o["start"] >= paragraph_start) & (o["start"] < end))
        around = t.window(low, s["start"], s["end"], FIGURE, FIGURE)
        stems = F.transform(t.letter_words(value), t.stem)
        pair = F.exists(figures, lambda f: F.size(F.array_except(F.split(f, " "), stems)) == 0)
        return F.lit(rules.public_figures) & clean & (_marker(around, ROLE_MARKERS) | t.has_life_years(around) | pair)

    def why(s):
        value = t.cut(text, s["start"], s["end"])
        left = lambda n: t.cut(low, s["start"] - n, s["start"])
        wins = lambda n, words: (_last(left(n), words) >= 0) & (_last(left(n), words) > _last(left(n), PERSONAL))
        number = s["type"].isin(NUMBERS)
        fio = s["type"] == "FIO"
        return (
            F.when(F.array_contains(allowed, t.plain(value)), "allow_list")
            .when((s["type"] != "IP_ADDRESS") & v.ipv4(value, leading_zeros=True), "network_address")
            .when(fio & common_word(value), "common_word")
            .when(fio & street_before(low, s), "street_name")
            .when(fio & figure(s, value), "public_figure")
            .when(number & wins(REQUISITE, REQUISITES), "org_requisites")
            .when(number & wins(REFERENCE, REFERENCES), "reference_number")
            .when(company(s), "org_address")
        )

    judged = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["conf"].alias("conf"), s["reason"].alias("reason"), why(s).alias("why")))

    def birth_place(s):
        famous = F.exists(judged, lambda o: (o["why"] == "public_figure") & (sentence_of(o["start"]) == sentence_of(s["start"])))
        return F.when((s["type"] == "BIRTH_PLACE") & famous, "public_figure").otherwise(s["why"])

    return F.transform(judged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["conf"].alias("conf"), s["reason"].alias("reason"), birth_place(s).alias("why")))


def staying(judged: Column) -> Column:
    return F.transform(F.filter(judged, lambda s: s["why"].isNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["conf"].alias("conf"), s["reason"].alias("reason")))


def going(judged: Column) -> Column:
    return F.transform(F.filter(judged, lambda s: s["why"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["conf"].alias("conf"), F.concat(s["reason"], F.lit("+"), s["why"]).alias("reason")))

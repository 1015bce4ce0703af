"""Findings by pattern and anchor: e-mail, account, insurance, plate, vehicle, network address, licences and other
documents are readers for the one Arrow call of a text; e-mails by shape and types of the user's own are projections
inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions import validators as v
from spanveil.operators.scan import Look, any_in, folded
from spanveil.schema import ANCHORED, HIGH, MEDIUM, SPANS

Found = Iterator[tuple[int, int, str, float, str]]

# Anchors, in lower case.
ACCOUNT = ("счёт", "счет", "р/с", "расчётный счёт", "расчетный счет", "лицевой счёт", "лицевой счет", "л/с", "номер счёта", "номер счета", "account", "зачислить на")
OMS = ("полис", "омс", "медицинский полис", "страховой полис", "номер полиса", "медицинская страховка")
PLATE = ("госномер", "г/н", "гос. номер", "гос номер", "номер автомобиля", "автомобиль", "машина", "транспортное средство", "тс", "госзнак", "гос знак", "регистрационный знак", "номер машины", "авто")
VIN = ("vin", "вин", "идентификационный номер", "номер кузова", "номер шасси")
IP = ("ip", "айпи", "с адреса", "вход с", "сессия с", "сетевой адрес", "адрес узла")
DRIVER = ("водительск", "в/у", "ву ", "права", "driver")
FOREIGN = ("загранпаспорт", "заграничн", "загран", "foreign passport")
BIRTH_CERT = ("свидетельств", "о рождении", "birth certificate")
MILITARY = ("военный билет", "военного билета", "военник", "military id")
PERMIT = ("вид на жительство", "вида на жительство", "внж", "residence permit")
SNILS_EXTRA = ("страховое свидетельство", "пенсионное страхование", "пенсионный номер", "номер индивидуального лицевого")

_MAIL = r"\p{L}\p{Nd}!#$%&'*+/=?^_`{|}~"
#: Leading dots and hyphens are taken in here and cut off later, so that a search starts once for each run of characters.
EMAIL = rf"(?<![{_MAIL}.-])[.-]*+[{_MAIL}][{_MAIL}.-]*+@[\p{{L}}\p{{Nd}}-]++(?:\.[\p{{L}}\p{{Nd}}-]++)*+"
#: The address itself: up to the last dot that letters follow.
ADDRESS = rf"[{_MAIL}][{_MAIL}.-]*+@[\p{{L}}\p{{Nd}}-].*\.\p{{L}}{{2,}}"
PLATE_LETTERS = "авекмнорстухabekmhopctyx"


def _spans(found: Column, kind: str, conf: float | Column, reason: str, keep=None) -> Column:
    conf = F.lit(conf) if isinstance(conf, float) else conf
    if keep is not None:
        found = F.filter(found, keep)
    return F.transform(found, lambda m: F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), F.lit(kind).alias("type"), conf.cast("double").alias("conf"), F.lit(reason).alias("reason"))).cast(SPANS)


def email_spans(text: Column) -> Column:
    """Addresses around an at-sign: a local part, a domain with a dot, a zone of two letters or more."""

    def span(m):
        value = F.regexp_extract(m["value"], ADDRESS, 0)
        start = m["start"] + F.length(m["value"]) - F.length(F.ltrim(m["value"], F.lit(".-")))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    return _spans(F.filter(F.transform(t.matches(text, EMAIL), span), lambda m: m["value"] != ""), "EMAIL", HIGH, "email:shape")


_LOCAL_SIGNS = frozenset("!#$%&'*+/=?^_`{|}~.-")
_DOMAIN = re.compile(r"(?:[^\W_]|-)++(?:\.(?:[^\W_]|-)++)*+")
_ZONED = re.compile(r".+\.[^\W\d_]{2,}")


def emails(look: Look) -> Found:
    """Expands every at-sign to both sides."""
    text, at, done = look.text, look.text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isalnum() or text[start - 1] in _LOCAL_SIGNS):
            start -= 1
        while start < at and text[start] in ".-":
            start += 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        zoned = _ZONED.match(domain[0]) if domain else None
        if zoned:
            done = at + 1 + zoned.end()
            yield start, done, "EMAIL", HIGH, "email:shape"
        at = text.find("@", at + 1)


_EDGE_L, _EDGE_R = r"(?<![^\W_])", r"(?![^\W_])"
_PLATE = re.compile(rf"{_EDGE_L}[{PLATE_LETTERS}] ?[0-9]{{3}} ?[{PLATE_LETTERS}]{{2}} ?[0-9]{{2,3}}{_EDGE_R}")
_VIN_CHARS = "0-9A-HJ-NPR-Za-hj-npr-z"
_VIN = re.compile(rf"{_EDGE_L}(?:[{_VIN_CHARS}]{{17}}|(?=[0-9A-Za-z ]{{18}}{_EDGE_R})(?=[^ ]{{0,17}}[0-9])[{_VIN_CHARS}]{{3,14}} [{_VIN_CHARS}]{{3,14}}){_EDGE_R}")
_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9/])")
_CYR, _LETTER = "Ѐ-ԯ", "[^\\W\\d_]"
_DRIVER = re.compile(rf"{_EDGE_L}[0-9]{{2}}\s?([{_CYR}A-Za-zÀ-ɏ]{{2}})\s?(?:№\s?)?[0-9]{{6}}{_EDGE_R}")
_CERTIFICATE = re.compile(rf"{_EDGE_L}[ivxlcхі]{{1,6}}\s?-\s?[{_CYR}]{{2}}\s?(?:№\s?)?[0-9]{{5,7}}{_EDGE_R}")
_MILITARY = re.compile(rf"{_EDGE_L}[{_CYR}]{{2}}\s?(?:№\s?)?([0-9]{{6,8}}){_EDGE_R}")
_TICKET = re.compile(r"билет[а-я]*\s+на\s")
_SERIES = str.maketrans(t.SERIES_LATIN, t.SERIES_CYRILLIC)
STANDARD = frozenset("авекмнорстух")
#: Windows in code points: around a value, right of it, before a vehicle number, before a document number.
AROUND, RIGHT, VEHICLE, DOCUMENT = 40, 24, 72, 60


def extras(look: Look) -> Found:
    """Account, insurance number, plate, vehicle number and network address, each with its anchor."""
    for r in look.runs:
        n = len(r.digits)
        if n == 20 and r.digits[:3] in ("408", "423", "426") and look.before(r.start, ACCOUNT, AROUND):
            yield r.start, r.end, "ACCOUNT", HIGH, "account:anchor"
        elif n == 16 and look.before(r.start, OMS, AROUND):
            yield r.start, r.end, "OMS", HIGH, "oms:anchor_luhn" if v.luhn_valid(r.digits) else "oms:anchor"
    sizes = {g for r in look.runs for g in r.groups}
    for m in _PLATE.finditer(look.low) if 3 in sizes else ():
        if look.has(*m.span(), PLATE, AROUND, RIGHT):
            yield *m.span(), "PLATE", HIGH, "plate:anchor"
    for m in _VIN.finditer(look.text) if any_in(look.fold, folded(VIN)[0]) else ():
        if any(c.isdigit() for c in m[0]) and len(m[0].replace(" ", "")) == 17 and look.has(*m.span(), VIN, VEHICLE, RIGHT):
            yield *m.span(), "VIN", HIGH, "vin:anchor"
    for m in _IP.finditer(look.text) if any(len(r.groups) > 3 and "." in r.seps for r in look.runs) else ():
        parts = m[0].split(".")
        good = all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in parts)
        service = parts[0] == "127" or parts[:2] == ["0", "0"]
        if good and not service and look.has(*m.span(), IP, AROUND, RIGHT):
            yield *m.span(), "IP_ADDRESS", HIGH, "ip:anchor"


def driver_letters(look: Look) -> Found:
    """Licence numbers with letters in the series: two digits, two letters, six digits."""
    for m in _DRIVER.finditer(look.low) if any(6 in r.groups for r in look.runs) else ():
        if any_in(look.low[max(0, m.start() - AROUND) : m.end() + 20], DRIVER):
            yield *m.span(), "DRIVER_LICENSE", HIGH, "driver_letters:anchor"
        elif STANDARD.issuperset(m[1].translate(_SERIES)):
            yield *m.span(), "DRIVER_LICENSE", ANCHORED, "driver_letters:shape"


def documents(look: Look) -> Found:
    """Pension number by its longer names, foreign passport, birth certificate, military card, residence permit."""
    for r in look.runs:
        n = len(r.digits)
        if n == 11 and look.before(r.start, SNILS_EXTRA, DOCUMENT):
            yield r.start, r.end, "SNILS", HIGH, "snils:extra_anchor"
        if r.groups in ((9,), (2, 7)) and look.before(r.start, FOREIGN, DOCUMENT):
            yield r.start, r.end, "FOREIGN_PASSPORT", HIGH, "foreign_passport:anchor"
    longest = max((g for r in look.runs for g in r.groups), default=0)
    if longest < 5:
        return
    for m in _CERTIFICATE.finditer(look.low) if "-" in look.low else ():
        yield *m.span(), "BIRTH_CERT", HIGH, "birth_cert:shape"
    for m in _MILITARY.finditer(look.low):
        left = look.low[max(0, m.start() - AROUND) : m.end()]
        if any_in(left, MILITARY):
            yield *m.span(), "MILITARY_ID", HIGH, "military:anchor"
        elif len(m[1]) == 7 and not _TICKET.search(left):
            yield *m.span(), "MILITARY_ID", ANCHORED, "military:shape"
    if not any_in(look.fold, folded(PERMIT)[0]) and "внж" not in look.fold.replace(" ", ""):
        return
    for r in look.runs:
        if 6 <= len(r.digits) <= 12 and look.before(r.start, PERMIT, DOCUMENT):
            yield r.start, r.end, "RESIDENCE_PERMIT", HIGH, "residence_permit:anchor"


@dataclass(frozen=True)
class CustomType:
    """A type of the user's own: a pattern (one group may be the value), anchors, a window, a check of the value."""

    name: str
    pattern: str
    group: int = 0
    anchors: tuple[str, ...] = ()
    window: int = 40
    validator: str = "none"
    values: list[str] = field(default_factory=list, compare=False)

    def check(self) -> None:
        """Refuses what cannot be run on every text: look-around, back-references, patterns that match nothing."""
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", self.pattern):
            raise ValueError(f"{self.name}: look-around and back-references are not supported")
        if re.compile(self.pattern).match(""):
            raise ValueError(f"{self.name}: the pattern matches an empty text")
        if self.validator not in VALIDATORS:
            raise ValueError(f"{self.name}: unknown validator {self.validator}")


VALIDATORS = {"none": None, "luhn": v.luhn, "inn": v.inn, "snils": v.snils}


def custom_spans(low: Column, rule: CustomType) -> Column:
    """The rule's findings: on one line, trimmed, with a confidence that grows with check and anchor."""
    rule.check()
    found = F.filter(t.matches(low, f"(?iu){rule.pattern}"), lambda m: ~m["value"].contains("\n"))
    if rule.group:
        inner = lambda m: F.regexp_extract(m["value"], f"(?iu){rule.pattern}", rule.group)
        found = F.transform(found, lambda m: F.struct((m["start"] + F.locate(inner(m), m["value"]) - 1).cast("int").alias("start"), (m["start"] + F.locate(inner(m), m["value"]) - 1 + F.length(inner(m))).cast("int").alias("end"), inner(m).alias("value")))
    check = VALIDATORS[rule.validator]

    def span(m):
        ends = t.trim_ends(low, m["start"], m["end"])
        good = check(t.digits_only(m["value"])) if check else F.lit(False)
        near = t.contains_any(t.window(low, m["start"], m["end"], rule.window, rule.window), [a.lower() for a in rule.anchors]) if rule.anchors else F.lit(False)
        conf = F.when(good & near, HIGH).when(good | near, ANCHORED).otherwise(MEDIUM)
        refused = ~good if check else F.lit(False)
        return F.struct(ends["start"].cast("int").alias("start"), ends["end"].cast("int").alias("end"), F.lit(rule.name.upper()).alias("type"), conf.cast("double").alias("conf"), F.when(refused & ~near, F.lit(None)).otherwise(F.lit("custom")).alias("reason"))

    return F.filter(F.transform(found, span), lambda s: s["reason"].isNotNull() & (s["start"] < s["end"])).cast(SPANS)

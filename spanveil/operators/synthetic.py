"""Made-up values that keep the kind and form of the value they stand for. The same value, type and seed give the same
result everywhere; checksums hold, and no result equals its original."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import validators as v
from spanveil.functions.names import FEMALE, LATIN, MALE, translit

_MASK = (1 << 64) - 1
# Invented places.
PLACES = ["Светлоград", "Новоозёрск", "Верхнереченск", "Каменный Яр", "Луговое", "Тихоборск", "Заполье", "Сосновец"]


def fnv64(data: str) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data.encode():
        h = ((h ^ b) * 0x100000001B3) & _MASK
    return h


class Draw:
    """A 64-bit linear congruential sequence."""

    def __init__(self, seed: int):
        self.x = seed

    def below(self, n: int) -> int:
        self.x = (self.x * 6364136223846793005 + 1442695040888963407) & _MASK
        return (self.x >> 33) % n


def _digits_into(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it, "0") if c.isdigit() else c for c in value)


def _random_digits(d: Draw, n: int) -> str:
    return "".join(str(d.below(10)) for _ in range(n))


def _name(value: str, d: Draw) -> str:
    latin = value.isascii()
    female = bool(re.search(r"(?:а|я|овна|евна|ova|eva|ina)\b", value.lower()))
    given = sorted(LATIN) if latin else sorted(FEMALE if female else MALE)
    surname = (translit if latin else str)(["лугов", "ветров", "озёрин", "громов", "ручьёв", "соснин", "полев"][d.below(7)]) + ("a" if latin else "а") * female
    middle = ["иванович", "петрович", "олегович"][d.below(3)] if not female else ["ивановна", "петровна", "олеговна"][d.below(3)]
    out = []
    for i, w in enumerate(re.split(r"(\s+)", value)):
        if not w.strip():
            out.append(w)
            continue
        if len(w.strip(".")) <= 1:
            new = "АБВГДЕКМНОПРСТ"[d.below(14)] + "." * w.count(".")
        elif re.search(r"(?:вич|вна|vich|vna)$", w.lower()):
            new = translit(middle) if latin else middle
        elif i == 0 and not re.search(r"(?:вич|вна)", value.lower()) and len(value.split()) > 1 or i == 0 and len(value.split()) == 3:
            new = surname
        else:
            new = given[d.below(len(given))]
        out.append(new.upper() if w.isupper() and len(w) > 2 else new if w.islower() else new[:1].upper() + new[1:])
    return "".join(out)


def _date(value: str, d: Draw) -> str:
    parts = re.findall(r"\d+", value)
    new = []
    for p in parts:
        if len(p) == 4:
            new.append(str(1950 + d.below(60)))
        else:
            new.append(str(1 + d.below(12)).zfill(len(p)) if len(p) == 2 else str(1 + d.below(9)))
    it = iter(new)
    return re.sub(r"\d+", lambda m: next(it), value)


def synthetic_value(value: str, kind: str, seed: int = 0) -> str:
    h = fnv64(f"{kind}|{value}") + seed
    digits = re.sub(r"\D", "", value)
    for attempt in range(8):
        d = Draw((h + attempt) & _MASK)
        if kind in ("FIO", "CARDHOLDER"):
            new = _name(value, d)
        elif kind == "EMAIL":
            new = f"user{_random_digits(d, 5)}@example.com"
        elif kind == "PHONE":
            keep = 2 if len(digits) >= 11 else 0
            new = _digits_into(value, digits[:keep] + _random_digits(d, len(digits) - keep))
        elif kind == "CARD" and len(digits) >= 13:
            body = digits[:4] + _random_digits(d, len(digits) - 5)
            new = _digits_into(value, next(body + str(c) for c in range(10) if v.luhn_valid(body + str(c)) or len(digits) > 19))
        elif kind == "INN" and len(digits) in (10, 12):
            body = _random_digits(d, len(digits) - (1 if len(digits) == 10 else 2))
            body += v._control(body, v.INN10 if len(digits) == 10 else v.INN12A)
            new = _digits_into(value, body if len(digits) == 10 else body + v._control(body, v.INN12B))
        elif kind == "SNILS" and len(digits) == 11:
            body = _random_digits(d, 9)
            new = _digits_into(value, body + str(sum(int(c) * (9 - i) for i, c in enumerate(body)) % 101 % 100).zfill(2))
        elif kind in ("DOB", "ISSUE_DATE"):
            new = _date(value, d)
        elif kind in ("ADDRESS", "BIRTH_PLACE"):
            new = f"г. {PLACES[d.below(len(PLACES))]}" + (f", ул. Новая, д. {1 + d.below(99)}" if kind == "ADDRESS" else "")
        elif digits:
            new = _digits_into(value, _random_digits(d, len(digits)))
        else:
            new = re.sub(r"[^\W\d_]+", lambda m: PLACES[d.below(len(PLACES))], value, count=1)
        if new != value:
            return new
    return "*" * len(value)


def replaced(text: str | None, spans: list[dict] | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for s in sorted(spans or [], key=lambda s: (s["start"], s["end"])):
        if at <= s["start"] < s["end"] <= len(text):
            out += [text[at : s["start"]], synthetic_value(text[s["start"] : s["end"]], s["type"])]
            at = s["end"]
    return "".join(out) + text[at:]


def synthetic_column(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def put(texts: pa.Array, sets: pa.Array, _: pa.Array) -> pa.Array:
        return pa.array([replaced(x, s) for x, s in zip(texts.to_pylist(), sets.to_pylist())], pa.string())

    # Referred to twice, the spans are computed before the call and not inside its arguments.
    return put(text, spans, F.size(spans))

"""Addresses: each kind of street, settlement, house or region is an anchor whose value is read beside it; parts close
together make one address."""

from __future__ import annotations

import re
from collections.abc import Iterator

from spanveil.operators.scan import Look
from spanveil.schema import ANCHORED, HIGH

Found = Iterator[tuple[int, int, str, float, str]]

# Words of address parts.
STREET = "улица улице улицы ул переулок переулке пер проезд проезде пр-д проспект проспекте просп пр-т пр-кт шоссе ш набережная наб бульвар бульваре б-р площадь площади пл аллея аллее тупик тракт микрорайон мкр квартал".split()
SETTLEMENT = "г гор город города городе с село пос посёлок поселок п дер деревня д ст станица пгт хутор аул снт".split()
REGION = "обл область области край края респ республика республики район района р-н округ".split()
HOUSE = "дом д корпус корп к строение стр квартира кв офис оф подъезд этаж помещение пом владение вл литера лит".split()
LATIN_STREET = "street st lane ln road rd avenue ave drive dr boulevard blvd square sq".split()
ANCHORS = ("адрес", "прожива", "зарегистрирован", "прописан", "доставк", "address", "lives at")
#: Between two parts, over a whole address.
GAP, LONGEST = 24, 120
_MARK = re.compile(r"(?<![\w-])(?:(?P<street>" + "|".join(sorted(map(re.escape, STREET), key=len, reverse=True)) + r")|(?P<house>" + "|".join(sorted(map(re.escape, HOUSE), key=len, reverse=True)) + r")|(?P<region>" + "|".join(sorted(map(re.escape, REGION), key=len, reverse=True)) + r")|(?P<town>" + "|".join(sorted(map(re.escape, SETTLEMENT), key=len, reverse=True)) + r")|(?P<latin>" + "|".join(sorted(LATIN_STREET, key=len, reverse=True)) + r"))(?![\w-])")
_NAME = r"[^\W\d_](?:[\w-]*+)"
_AFTER = re.compile(rf"\.?[ \t]{{0,3}}(?:(?:им|имени)\.?[ \t]{{1,3}})?[«\"]?(?:\d{{1,3}}-?[а-я]{{1,2}}[ \t]{{1,3}})?({_NAME}(?:[ \t]{{1,3}}{_NAME}){{0,2}})[»\"]?")
_BEFORE = re.compile(rf"(?<![\w-]){_NAME}(?:[ \t]{{1,3}}{_NAME})?[ \t]{{1,3}}$")
_NUMBER = re.compile(r"\.?[ \t]{0,3}(?:№[ \t]{0,2})?\d{1,4}(?:[ \t]?[/-][ \t]?\d{1,4})?[ \t]?(?:[а-яa-z](?![\w.]))?(?!\d)")
_BARE_HOUSE = re.compile(r"[ \t]{0,3},?[ \t]{0,3}\d{1,4}(?:[/-]\d{1,4})?[а-я]?(?![\w])(?!\.\d)")
_TOWN = re.compile(rf"\.?[ \t]{{0,3}}{_NAME}(?:[ \t]{_NAME})?")
_POSTCODE = re.compile(r"(?<!\d)\d{6}[ \t]{0,2},?[ \t]{0,3}$")
_LATIN = re.compile(r"(?<![\w.,/-])\d{1,4}[a-z]?[ \t]{1,3}[^\W\d_]+(?:[ \t]{1,3}[^\W\d_]+)?[ \t]{1,3}$")
_TAIL_REGION = re.compile(r"[ \t]{0,2}\([^()\n\d]{2,30}(?:обл|край|респ|р-н|район)[^()\n\d]{0,12}\)")
#: Words that end the name of a street or a town.
_NO_NAME = frozenset("и в на с по у о от до за из к для не что как это был была дом д кв корп стр корпус квартира офис улица ул".split())


def _trimmed_name(low: str, m: re.Match) -> int:
    """The end of a name, up to a word that cannot belong to one."""
    at, end = m.start(1), m.start(1)
    for w in re.finditer(r"[^\s]+", m[1]):
        if w[0] in _NO_NAME:
            break
        end = at + w.end()
    return end


def parts(look: Look) -> Iterator[tuple[int, int, str]]:
    low, done = look.low, 0
    for m in _MARK.finditer(low):
        s, e = m.span()
        if s < done:
            continue
        kind = m.lastgroup
        if kind == "street":
            after = _AFTER.match(low, e)
            end = _trimmed_name(low, after) if after else e
            before = _BEFORE.search(low, max(0, s - 40), s) if len(m[0]) > 2 and end <= e or low[e : e + 1] in ",\n" else None
            start = s
            if before and (end <= e or before[0].split()[-1].endswith(("ая", "ий", "ый", "ой", "ое", "ой"))):
                start, end = before.start() if before[0].split()[0] not in _NO_NAME else before.start() + len(before[0]) - len(before[0].split(None, 1)[-1]), e
            if end > e or start < s:
                yield start, end, "street"
                house = _BARE_HOUSE.match(low, end)
                if house:
                    yield end + len(house[0]) - len(house[0].lstrip(" \t,")), house.end(), "house"
                    end = house.end()
                done = end
        elif kind == "house" or kind == "town" and m[0] == "д":
            number = _NUMBER.match(low, e)
            if number and (low[e : e + 1] in ". №" or number[0].strip()[:1].isdigit()):
                yield s, e + len(number[0].rstrip()), "house"
                done = number.end()
        elif kind == "town":
            name = _TOWN.match(low, e)
            if name and (low[e : e + 1] == "." or len(m[0]) > 2) and look.text[name.end() - len(name[0].lstrip(". \t")) :][:1].isupper():
                yield s, e + len(name[0].split(" и ")[0].rstrip()), "town"
                done = e + 1
        elif kind == "region":
            before = _BEFORE.search(low, max(0, s - 40), s)
            if before and before[0].split()[-1].endswith(("ая", "ий", "ой", "ый", "ской", "ского", "кого")):
                yield s - len(before[0].split()[-1]) - (len(before[0]) - len(before[0].rstrip())), e + (low[e : e + 1] == "."), "region"
        elif kind == "latin":
            before = _LATIN.search(low, max(0, s - 60), s)
            if before:
                yield before.start(), e, "latin"
                done = e


def addresses(look: Look) -> Found:
    """Groups of parts: street and house, or more kinds, for sure; one kind only behind a word for an address."""
    group: list[tuple[int, int, str]] = []
    for part in sorted(parts(look)):
        if group:
            gap = look.low[group[-1][1] : part[0]]
            if part[0] < group[-1][1]:
                if part[1] > group[-1][1] and part[2] != group[-1][2]:
                    group.append((group[-1][1], part[1], part[2]))
                continue
            if len(gap) > GAP or part[1] - group[0][0] > LONGEST or any(c in "\n;:" or c.isdigit() for c in gap) or len(re.findall(r"[^\W\d_]+", gap)) > 2:
                yield from _address(look, group)
                group = []
        group.append(part)
    yield from _address(look, group)


def _address(look: Look, group: list[tuple[int, int, str]]) -> Found:
    if not group:
        return
    start, end, kinds = group[0][0], group[-1][1], {g[2] for g in group}
    code = _POSTCODE.search(look.low, max(0, start - 14), start)
    if code:
        start = code.start()
    region = _TAIL_REGION.match(look.low, end)
    if region:
        end = region.end()
    elif "(" in look.low[start:end] and look.low[end : end + 1] == ")":
        end += 1
    if kinds & {"street", "latin"} and (len(kinds) > 1 or "latin" in kinds) or len(kinds) > 1 and "house" in kinds and kinds & {"town"}:
        yield start, end, "ADDRESS", HIGH, "address:latin" if "latin" in kinds else "address:parts"
    elif kinds != {"house"} and look.has(start, start, ANCHORS, 40, 0):
        yield start, end, "ADDRESS", ANCHORED, "address:anchor"

"""Which findings of a text belong to one subject: same sentence, same questionnaire, same value. Everything is
computed within the row, as a text's findings are few; no shuffle."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that begin a line of a questionnaire.
FORM_ANCHORS = (
    "фио", "фамилия", "имя", "отчество", "телефон", "тел", "мобильный", "контактный", "паспорт", "серия", "номер паспорта", "кем выдан", "дата выдачи", "инн", "снилс",
    "адрес", "индекс", "место рождения", "гражданство", "карта", "номер карты", "пин", "пин-код", "cvv", "почта", "email", "e-mail", "водительское",
)
SENTENCE_CONF, SURE_CONF = 0.6, 0.9
_STOP = re.compile(r"\n|[.!?;](?=[ \n]|$)")
_FORM = re.compile("(?:" + "|".join(re.escape(a) for a in FORM_ANCHORS) + "):", re.I)
_TYPE = pa.list_(pa.struct([("subject", pa.int32()), ("sentence", pa.int32()), ("form", pa.int32()), ("value", pa.string())]))


def link(text: str | None, spans: list[dict] | None) -> list[dict]:
    """For each span: its subject (the place of the subject's first span), sentence, questionnaire (NULL outside one)
    and compared value. Subjects are the connected components over the three groupings."""
    spans = spans or []
    if not text or not spans:
        return [{"subject": i, "sentence": 0, "form": None, "value": ""} for i in range(len(spans))]
    stops = [m.end() for m in _STOP.finditer(text)]
    forms, at, form = [], 0, 0
    inside = False
    for line in text.split("\n"):
        hit = bool(_FORM.match(line))
        form += hit and not inside
        inside = hit
        forms.append((at, form if hit else None))
        at += len(line) + 1
    starts = [a for a, _ in forms]
    out = []
    parent = list(range(len(spans)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple, int] = {}
    for i, s in enumerate(spans):
        sentence = bisect_right(stops, s["start"])
        block = forms[bisect_right(starts, s["start"]) - 1][1]
        value = " ".join(text[s["start"] : s["end"]].lower().split())
        out.append({"sentence": sentence, "form": block, "value": value})
        for key in (("s", sentence), ("f", block), ("v", value)):
            if key[1] is None or key[1] == "":
                continue
            j = find(first.setdefault(key, i))
            k = find(i)
            parent[max(j, k)] = min(j, k)
    for i, x in enumerate(out):
        x["subject"] = find(i)
    return out


def links(text: Column, spans: Column) -> Column:
    @F.arrow_udf("array<struct<subject:int,sentence:int,form:int,value:string>>")
    def run(texts: pa.Array, sets: pa.Array, _: pa.Array) -> pa.Array:
        return pa.array([link(x, s) for x, s in zip(texts.to_pylist(), sets.to_pylist())], _TYPE)

    # Referred to twice, the spans are computed before the call and not inside its arguments.
    return run(text, spans, F.size(spans))


def edges_of(text: str | None, spans: list[dict] | None, clique: bool = False) -> list[dict]:
    """(a, b, basis, conf) for spans that share a sentence, a questionnaire or a value, by basis: each with the first of its
    group, so there are no more links than spans; with `clique`, each two."""
    linked = link(text, spans)
    out = []
    for basis, conf in (("sentence", SENTENCE_CONF), ("form", SURE_CONF), ("value", SURE_CONF)):
        groups: dict = {}
        for i, x in enumerate(linked):
            if x[basis] not in (None, ""):
                groups.setdefault(x[basis], []).append(i)
        name = {"form": "anchor", "value": "repeat"}.get(basis, basis)
        out += [{"a": a, "b": b, "basis": name, "conf": conf} for g in groups.values() for k, a in enumerate(g if clique else g[:1]) for b in g[k + 1 :]]
    return out


def edges(text: Column, spans: Column, clique: bool = False) -> Column:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("basis", pa.string()), ("conf", pa.float64())]))

    @F.arrow_udf("array<struct<a:int,b:int,basis:string,conf:double>>")
    def run(texts: pa.Array, sets: pa.Array, _: pa.Array) -> pa.Array:
        return pa.array([edges_of(x, s, clique) for x, s in zip(texts.to_pylist(), sets.to_pylist())], kind)

    # Referred to twice, the spans are computed before the call and not inside its arguments.
    return run(text, spans, F.size(spans))


def required(spans: Column, linked: Column, rules: Column) -> Column:
    """Spans that co-occurrence rules keep: a span whose type a rule names stays only if its subject also holds one
    of the types that the rule requires. `rules` is an array of (mask, requires)."""
    joined = F.transform(spans, lambda s, i: F.struct(s.alias("s"), F.get(linked, i)["subject"].alias("subject")))

    def holds(x, rule):
        return F.exists(joined, lambda y: (y["subject"] == x["subject"]) & F.array_contains(rule["requires"], y["s"]["type"]))

    return F.transform(F.filter(joined, lambda x: F.forall(F.filter(rules, lambda r: r["mask"] == x["s"]["type"]), lambda r: holds(x, r))), lambda x: x["s"])

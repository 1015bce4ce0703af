"""A text's whole path in one Arrow call: findings, policy filters, resolution and masking, in time linear in the text and
its findings. The column functions of `spans` and `masking` say the same step by step (tests compare them)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.operators import words
from spanveil.operators.synthetic import synthetic_value
from spanveil.schema import PRIORITY, SPANS

Span = tuple[int, int, str, float, str]
RESULT = f"struct<kept:{SPANS},dropped:{SPANS},masked:string,placeholders:array<struct<token:string,value:string,type:string>>,degraded:boolean>"
_PLACEHOLDERS = pa.list_(pa.struct([("token", pa.string()), ("value", pa.string()), ("type", pa.string())]))


def resolve(spans: list[Span], least: float) -> tuple[list[Span], list[Span]]:
    """(kept, dropped): from left to right, a span that overlaps the first kept one it meets replaces it if it is longer,
    else of higher priority, else surer; otherwise it is dropped. Starts never fall, so kept spans that end before a
    start are passed for good."""
    kept: list[Span] = []
    dropped: list[Span] = []
    passed = 0
    for s in sorted((s for s in spans if 0 <= s[0] < s[1]), key=lambda s: (s[0], s[0] - s[1], -s[3])):
        start, end, kind, conf, reason = s
        if conf < least:
            dropped.append((start, end, kind, conf, reason + "+below_min_confidence"))
            continue
        while passed < len(kept) and kept[passed][1] <= start:
            passed += 1
        at = next((k for k in range(passed, len(kept)) if kept[k][1] > start and kept[k][0] < end), None)
        if at is None:
            kept.append(s)
            continue
        rival = kept[at]
        better = (end - start, PRIORITY.get(kind, 0), conf) > (rival[1] - rival[0], PRIORITY.get(rival[2], 0), rival[3])
        loser = rival if better else s
        if better:
            kept[at] = s
        dropped.append((*loser[:4], loser[4] + "+overlap_lost"))
    return sorted(kept, key=lambda s: (s[0], s[0] - s[1], -s[3])), dropped


_SOLID = re.compile(r"[^\W_]")
_INITIAL = re.compile(r"[^\W\d_](?:[^\W\d_]|-)*")
_VISIBLE = re.compile(r"\S")


def partial(value: str) -> str:
    places = [m.start() for m in _SOLID.finditer(value)]
    if len(places) < 6:
        return "*" * len(value)
    a, b = places[1] + 1, places[-2]
    return value[:a] + _SOLID.sub("*", value[a:b]) + value[b:]


def initials(value: str) -> str:
    short = " ".join(w[0].upper() + "." for w in _INITIAL.findall(value))
    return short or "*" * len(value)


_LIKE_PLACEHOLDER = re.compile(r"[^\W\d]+_\d+")


def spoken_for(text: str) -> set[str]:
    """What looks like a placeholder in a text already, in capitals without brackets."""
    return {x.upper() for x in _LIKE_PLACEHOLDER.findall(text)} if "_" in text else set()


def next_token(kind: str, count: dict[str, int], spoken: set[str]) -> str:
    """The next placeholder of a type; numbers that the text uses itself are passed over, so that restoring stays exact."""
    count[kind] = count.get(kind, 0) + 1
    while f"{kind}_{count[kind]}" in spoken:
        count[kind] += 1
    return f"[{kind}_{count[kind]}]"


def masked(text: str, spans: list[Span], preset: str) -> tuple[str, list[tuple[str, str, str]] | None]:
    """The text with its spans replaced, and the placeholders put in under the token preset. Spans are by place; those that
    overlap what is replaced already are skipped."""
    out: list[str] = []
    at = 0
    numbers: dict[tuple[str, str], str] = {}
    count: dict[str, int] = {}
    placeholders = []
    spoken = spoken_for(text) if preset == "token" else set()
    for start, end, kind, _, _ in spans:
        value = text[start:end]
        if preset == "token":
            token = numbers.get((kind, value))
            if token is None:
                token = numbers[kind, value] = next_token(kind, count, spoken)
            placeholders.append((token, value, kind))
        if start < at or end > len(text):
            continue
        if preset == "token":
            put = token
        elif preset == "full_ws":
            put = _VISIBLE.sub("*", value)
        elif preset == "partial":
            put = partial(value)
        elif preset == "initials":
            put = initials(value)
        elif preset == "synthetic":
            put = synthetic_value(value, kind)
        else:
            put = "*" * (end - start)
        out += [text[at:start], put]
        at = end
    return "".join(out) + text[at:], placeholders if preset == "token" else None


def processed(text: str | None, found: list[Span], preset: str, least: float, allowed, date_mode: str | None) -> tuple:
    spans = found
    if allowed:
        spans = [s for s in spans if s[2] in allowed]
    if date_mode == "anchor_only":
        spans = [s for s in spans if s[2] not in ("DOB", "ISSUE_DATE") or "_anchor" in s[4]]
    kept, dropped = resolve(spans, least)
    put, placeholders = masked(text, kept, preset) if text else (text, [] if preset == "token" else None)
    return kept, dropped, put, placeholders, any(s[4] == "failed" for s in found)


def one_pass(text: Column, preset: Column, least: Column, allowed: Column | None, date_mode: Column | None, wanted: tuple[str, ...], as_of_year: int = 2026) -> Column:
    """(kept, dropped, masked, placeholders, degraded) of each text. NULL stays NULL with no spans. Under the mode `any`
    or `pii_context` of a row, its dates are read so."""
    types, readers = frozenset(wanted), list(words.READERS)

    def array(values, kind):
        return pa.array(values, kind)

    def run(texts, presets, confs, sets, modes) -> pa.Array:
        rows = []
        for x, p, c, a, m in zip(texts.to_pylist(), presets.to_pylist(), confs.to_pylist(), sets.to_pylist(), modes.to_pylist()):
            mode = m or "pii_context"
            found = words.read(x, types, as_of_year, mode if mode != "anchor_only" else "pii_context", readers)
            rows.append(processed(x, found, p or "full", 0.6 if c is None else c, a, m))
        kept, dropped, put, placeholders, degraded = zip(*rows) if rows else ((),) * 5
        return pa.StructArray.from_arrays(
            [words.as_array(list(kept)), words.as_array(list(dropped)), array(put, pa.string()), array([None if x is None else [dict(zip(("token", "value", "type"), y)) for y in x] for x in placeholders], _PLACEHOLDERS), array(degraded, pa.bool_())],
            names=["kept", "dropped", "masked", "placeholders", "degraded"],
        )

    @F.arrow_udf(RESULT)
    def call(texts: pa.Array, presets: pa.Array, confs: pa.Array, sets: pa.Array, modes: pa.Array) -> pa.Array:
        return run(texts, presets, confs, sets, modes)

    none = F.lit(None).cast("array<string>") if allowed is None else allowed
    mode = F.lit(None).cast("string") if date_mode is None else date_mode
    # Marked so, the optimiser neither repeats nor moves the call: each text is read once.
    return call.asNondeterministic()(text, preset, least.cast("double"), none, mode)

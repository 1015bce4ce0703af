"""Masking of conversations: placeholders are numbered through all turns of one conversation, and answers restored."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions.names import declined
from spanveil.operators import masking, onepass, pipeline, words
from spanveil.runtime import durable
from spanveil.schema import ALL_TYPES


def masked_turns(df: DataFrame, conversation: str, turn: str, text: str, **kw) -> DataFrame:
    """`df` with masked text and the turn's placeholders [TYPE_n], n counting the distinct values of a type through the
    conversation. Numbers come from distinct (conversation, type, value) rows, not from gathered turns, so a
    conversation of any length is no group in one task."""
    found = pipeline.settled(pipeline.detected(df.select(conversation, turn, text), text, **kw))
    spans = found.select(conversation, turn, F.posexplode("kept").alias("pos", "s"), text)
    spans = spans.select(conversation, turn, "pos", "s.start", "s.end", "s.type", t.cut(F.col(text), F.col("s.start"), F.col("s.end")).alias("value"))
    first = spans.groupBy(conversation, "type", "value").agg(F.min(F.struct(turn, "pos")).alias("first"))
    number = F.row_number().over(Window.partitionBy(conversation, "type").orderBy("first"))
    tokens = first.select(conversation, "type", "value", F.concat(F.lit("["), F.col("type"), F.lit("_"), number.cast("string"), F.lit("]")).alias("token"))
    parts = spans.join(tokens, [conversation, "type", "value"]).groupBy(conversation, turn).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.col("token").alias("put"), "value", "type"))).alias("parts")
    )
    out = df.join(parts, [conversation, turn], "left")
    put = F.coalesce(F.col("parts"), F.array().cast("array<struct<start:int,end:int,put:string,value:string,type:string>>"))
    return out.withColumn("masked", masking.spliced(F.col(text), put)).withColumn("placeholders", F.array_distinct(F.transform(put, lambda p: F.struct(p["put"].alias("token"), p["value"].alias("value"), p["type"].alias("type"))))).drop("parts")


def merged_mappings(loaded: DataFrame, fresh: DataFrame, conversation: str) -> DataFrame:
    """Placeholders (conversation, token, value) of what is stored and of new turns; of one token the new value stays. A
    grouped maximum over the union: no conversation is gathered in one row."""
    both = loaded.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return both.groupBy(conversation, "token").agg(F.max_by("value", "_new").alias("value"))


def restored_answers(answers: DataFrame, masked: DataFrame, conversation: str, text: str) -> DataFrame:
    """Answers with the conversation's placeholders put back. Only the placeholders that an answer names are joined to it,
    so a conversation's whole list never lies in one row."""
    named = answers.withColumn("_row", F.monotonically_increasing_id())
    tokens = F.transform(F.regexp_extract_all(F.upper(text), F.lit(r"[\[({<]([\p{Lu}_]+_[0-9]++)[\])}>]"), F.lit(1)), lambda x: F.concat(F.lit("["), x, F.lit("]")))
    named = durable(named.withColumn("_tokens", F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))))
    table = masked.select(conversation, F.explode("placeholders").alias("p")).groupBy(conversation, F.upper("p.token").alias("token")).agg(F.min("p").alias("p"))
    asked = named.select("_row", conversation, F.explode("_tokens").alias("token"))
    found = asked.join(table, [conversation, "token"]).groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("placeholders"))
    return masking.restored(named.join(found, "_row", "left").drop("_row", "_tokens"), text, "placeholders")


#: Keys of tools and answer formats whose texts a model reads.
DESCRIBED = ("title", "description")


def walked(request: dict, change: Callable[[str], str]) -> dict:
    """A chat request with `change` applied to the texts a model reads: message contents, be they one text or parts, and
    titles and descriptions anywhere in tools and answer format. Everything else stays."""

    def content(x):
        if isinstance(x, str):
            return change(x)
        if isinstance(x, list):
            return [{**p, "text": change(p["text"])} if isinstance(p, dict) and isinstance(p.get("text"), str) else p for p in x]
        return x

    def described(x):
        if isinstance(x, dict):
            return {k: change(y) if k in DESCRIBED and isinstance(y, str) else described(y) for k, y in x.items()}
        return [described(y) for y in x] if isinstance(x, list) else x

    out = dict(request)
    if isinstance(request.get("messages"), list):
        out["messages"] = [{**m, "content": content(m.get("content"))} if isinstance(m, dict) and "content" in m else m for m in request["messages"]]
    for k in ("tools", "response_format"):
        if k in request:
            out[k] = described(request[k])
    return out


_NUMBERED = re.compile(r"^\[(.+)_(\d+)\]$")
_PAIRS = "array<struct<token:string,value:string,type:string>>"


class Numbering:
    """Placeholders of a conversation: known values keep theirs, new ones count on."""

    def __init__(self, known: list[dict] | None):
        self.pairs = [dict(p) for p in known or []]
        self.tokens = {(p["type"], p["value"]): p["token"] for p in self.pairs}
        self.count: dict[str, int] = {}
        for p in self.pairs:
            m = _NUMBERED.match(p["token"])
            if m:
                self.count[p["type"]] = max(self.count.get(p["type"], 0), int(m[2]))

    def __call__(self, text: str) -> str:
        kept, _ = onepass.resolve(words.read(text, frozenset(ALL_TYPES), 2026, "pii_context"), 0.6)
        out, at, spoken = [], 0, onepass.spoken_for(text)
        for start, end, kind, _, _ in kept:
            if start < at:
                continue
            value = text[start:end]
            token = self.tokens.get((kind, value))
            if token is None:
                token = self.tokens[kind, value] = onepass.next_token(kind, self.count, spoken)
                self.pairs.append({"token": token, "value": value, "type": kind})
            out += [text[at:start], token]
            at = end
        return "".join(out) + text[at:]


def masked_requests(df: DataFrame, request: str, known: str | None = None) -> DataFrame:
    """`df` with `masked` (the request with placeholders), `placeholders` (those of the column `known` and the new ones) and
    `status`: 200, 400 for streamed requests, 422 for what is no request."""

    @F.arrow_udf(f"struct<masked:string,placeholders:{_PAIRS},status:int>")
    def run(requests: pa.Array, stored: pa.Array) -> pa.Array:
        rows = []
        for x, k in zip(requests.to_pylist(), stored.to_pylist()):
            try:
                body = json.loads(x)
            except (TypeError, ValueError):
                body = None
            if not isinstance(body, dict) or not isinstance(body.get("messages"), list):
                rows.append({"masked": None, "placeholders": k, "status": 422})
            elif body.get("stream"):
                rows.append({"masked": None, "placeholders": k, "status": 400})
            else:
                number = Numbering(k)
                rows.append({"masked": json.dumps(walked(body, number), ensure_ascii=False), "placeholders": number.pairs, "status": 200})
        pair = pa.list_(pa.struct([("token", pa.string()), ("value", pa.string()), ("type", pa.string())]))
        return pa.array(rows, pa.struct([("masked", pa.string()), ("placeholders", pair), ("status", pa.int32())]))

    stored = F.lit(None).cast(_PAIRS) if known is None else F.col(known)
    return df.withColumn("_r", run.asNondeterministic()(F.col(request), stored)).withColumns({c: F.col(f"_r.{c}") for c in ("masked", "placeholders", "status")}).drop("_r")


def table_of(pairs: list[dict] | None) -> dict[str, str]:
    """What is put back for what: each placeholder as it is, in lower case and in other brackets; a made-up name also in
    the cases a model may have put it in."""
    out: dict[str, str] = {}
    for p in pairs or []:
        token = p["token"]
        forms = [token, token.lower()]
        if token[:1] == "[" and token[-1:] == "]":
            forms += [f"({token[1:-1]})", f"{{{token[1:-1]}}}", f"<{token[1:-1]}>"]
        elif p["type"] in ("FIO", "CARDHOLDER"):
            forms += declined(token)
        for form in forms:
            out.setdefault(form, p["value"])
    return out


def put_back(text: str, table: dict[str, str]) -> str:
    """All forms replaced in one pass, the longest first."""
    if not table:
        return text
    return re.sub("|".join(re.escape(k) for k in sorted(table, key=len, reverse=True)), lambda m: table[m[0]], text)


def restored_responses(df: DataFrame, response: str, placeholders: str) -> DataFrame:
    """`df` with `restored`: the answer of a model with placeholders put back in the contents of its choices, whole messages
    and pieces of streamed ones; nothing else of the answer changes. What is no JSON object stays."""

    def content(part, table):
        if isinstance(part, dict) and isinstance(part.get("content"), str):
            return {**part, "content": put_back(part["content"], table)}
        return part

    @F.arrow_udf("string")
    def run(answers: pa.Array, stored: pa.Array) -> pa.Array:
        out = []
        for x, pairs in zip(answers.to_pylist(), stored.to_pylist()):
            try:
                body = json.loads(x)
            except (TypeError, ValueError):
                body = None
            if isinstance(body, dict) and isinstance(body.get("choices"), list):
                table = table_of(pairs)
                body["choices"] = [{k: content(y, table) if k in ("message", "delta") else y for k, y in c.items()} if isinstance(c, dict) else c for c in body["choices"]]
                x = json.dumps(body, ensure_ascii=False)
            out.append(x)
        return pa.array(out, pa.string())

    return df.withColumn("restored", run(F.col(response), F.col(placeholders)))

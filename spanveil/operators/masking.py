"""Masking presets as projections, splicing them into texts, and undoing them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.operators.synthetic import synthetic_column

PRESETS = ("full", "full_ws", "partial", "initials", "token", "synthetic")


def keeps_length(preset: str) -> bool:
    return preset in ("full", "full_ws", "partial")


def full(value: Column) -> Column:
    """One star for each character."""
    return F.repeat(F.lit("*"), F.length(value))


def full_ws(value: Column) -> Column:
    """Stars, blanks kept."""
    return F.regexp_replace(value, r"(?U)\S", "*")


def partial(value: Column) -> Column:
    """The first and last two letters or digits and all signs stay; with fewer than six of them, all stars."""
    solid, other = r"[\p{L}\p{Nd}]", r"[^\p{L}\p{Nd}]"
    head = F.regexp_extract(value, rf"^{other}*+{solid}{other}*+{solid}", 0)
    tail = F.regexp_extract(value, rf"{solid}{other}*+{solid}{other}*+$", 0)
    n = F.length(F.regexp_replace(value, other, ""))
    middle = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    return F.when(n < 6, full(value)).otherwise(F.concat(head, F.regexp_replace(middle, solid, "*"), tail))


def initials(value: Column) -> Column:
    """The first letter of each word with a dot; stars for a value without letters. A hyphen does not part words."""
    words = F.regexp_extract_all(value, F.lit(r"\p{L}[\p{L}-]*"), F.lit(0))
    short = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
    return F.when(F.size(words) == 0, full(value)).otherwise(short)


def by_preset(value: Column, preset: Column, kind: Column, token: Column) -> Column:
    return (
        F.when(preset == "full_ws", full_ws(value)).when(preset == "partial", partial(value)).when(preset == "initials", initials(value))
        .when(preset == "token", token).when(preset == "synthetic", F.concat(F.lit("["), kind, F.lit("]"))).otherwise(full(value))
    )


def preset_for(kind: Column, per_type: Column, default: Column) -> Column:
    """The preset of a type, else the default, else full."""
    return F.coalesce(F.try_element_at(per_type, kind), default, F.lit("full"))


def with_values(text: Column, spans: Column) -> Column:
    """Spans with their text."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), t.cut(text, s["start"], s["end"]).alias("value")))


def numbered(valued: Column) -> Column:
    """Spans with a placeholder [TYPE_n]: n counts the distinct values of a type by first appearance."""

    def token(s):
        mine = F.filter(valued, lambda o: o["type"] == s["type"])
        values = F.array_distinct(F.transform(mine, lambda o: o["value"]))
        return F.concat(F.lit("["), s["type"], F.lit("_"), F.array_position(values, s["value"]).cast("string"), F.lit("]"))

    return F.transform(valued, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["value"].alias("value"), token(s).alias("token")))


def spliced(text: Column, parts: Column) -> Column:
    """The text with each (start, end, put) replaced. Parts must be by place; those that overlap what is already
    replaced, are empty or lie outside the text are skipped."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, p):
        good = (p["start"] >= acc["at"]) & (p["end"] > p["start"]) & (p["end"] <= F.length(text))
        return F.when(good, F.struct(p["end"].alias("at"), F.concat(acc["out"], t.cut(text, acc["at"], p["start"]), p["put"]).alias("out"))).otherwise(acc)

    return F.aggregate(parts, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def masked(text: Column, spans: Column, preset: Column) -> Column:
    """(text, placeholders) under one preset. Synthetic values need `mask_synthetic`. Values are numbered under the token
    preset only."""
    valued = with_values(text, spans)
    none = F.lit(None).cast("string")
    tokens = F.when(preset == "token", numbered(valued)).otherwise(F.transform(valued, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["value"].alias("value"), none.alias("token"))))

    def both(tokens):
        parts = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by_preset(s["value"], preset, s["type"], s["token"]).alias("put")))
        return F.struct(spliced(text, parts).alias("text"), F.when(preset == "token", F.transform(tokens, lambda s: F.struct(s["token"].alias("token"), s["value"].alias("value"), s["type"].alias("type")))).alias("placeholders"))

    return t.let(tokens, both)


def mask_synthetic(df: DataFrame, text: str, spans: str, into: str = "masked") -> DataFrame:
    """Values replaced by made-up ones of the same kind and form; equal values of a text get equal ones."""
    return df.withColumn(into, synthetic_column(F.col(text), F.col(spans)))


def looks_masked(text: Column, preset: Column) -> Column:
    """Whether at least half of a text's letters and signs are stars, placeholders or initials, by preset."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    size = F.greatest(solid, F.lit(1))
    stars = F.length(F.regexp_replace(text, r"[^*]", "")) / size
    inside = lambda p: 1 - F.length(F.regexp_replace(F.regexp_replace(text, p, ""), r"\s", "")) / size
    return F.when(solid == 0, False).when(preset == "token", inside(r"\[[\p{Lu}_]+_[0-9]+\]") >= 0.5).when(preset == "initials", inside(r"(?<!\p{L})\p{Lu}\.") >= 0.5).otherwise(stars >= 0.5)


def restored(df: DataFrame, text: str, placeholders: str, into: str = "restored") -> DataFrame:
    """Placeholders put back in one pass, longest first: written as they are, in lower case, with other brackets, or, for made-up
    names, in another case."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from spanveil.operators.chat import put_back, table_of

        for b in batches:
            pairs = b.column(b.schema.get_field_index(placeholders)).to_pylist()
            texts = [put_back(x, table_of(p)) if x and p else x for x, p in zip(b.column(b.schema.get_field_index(text)).to_pylist(), pairs)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(back, f"{schema}, `{into}` string")

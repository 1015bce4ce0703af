"""Algebra of span sets: filters, resolution of overlaps, merging. Span sets are arrays of (start, end, type, conf,
reason) in one column, so every operator here is a projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.schema import PRIORITY, SPAN, SPANS


def overlap(a: Column, b: Column) -> Column:
    """Half-open overlap; touching spans do not."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def priority(kind: Column) -> Column:
    """0 for types of the user's own."""
    table = F.create_map(*[F.lit(x) for k, n in PRIORITY.items() for x in (k, n)])
    return F.coalesce(table[kind], F.lit(0))


def _compare(a: Column, b: Column) -> Column:
    length = lambda s: s["end"] - s["start"]
    return (
        F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(length(a) > length(b), -1).when(length(a) < length(b), 1)
        .when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).otherwise(0)
    )


def ordered(spans: Column) -> Column:
    """By start, then the longer, then the surer; ties keep their order (the place in the array is compared last)."""
    numbered = F.transform(spans, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.transform(F.array_sort(numbered, lambda a, b: F.when(_compare(a["s"], b["s"]) == 0, a["i"] - b["i"]).otherwise(_compare(a["s"], b["s"]))), lambda x: x["s"])


def _better(a: Column, b: Column) -> Column:
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    pa, pb = priority(a["type"]), priority(b["type"])
    return (la > lb) | ((la == lb) & ((pa > pb) | ((pa == pb) & (a["conf"] > b["conf"]))))


def _noted(s: Column, note: str) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["conf"].alias("conf"), F.concat(s["reason"], F.lit("+" + note)).alias("reason"))


def resolved(spans: Column, min_conf: Column | float) -> Column:
    """(kept, dropped): a fold from left to right. A span that overlaps the first kept one it meets replaces it if it
    is longer, else of higher priority, else surer; otherwise it is dropped. Equality with `min_conf` keeps."""
    least = F.lit(min_conf) if isinstance(min_conf, float) else min_conf
    none = F.array().cast(SPANS)
    start = F.struct(none.alias("kept"), none.alias("dropped"))

    def step(acc, s):
        valid = (s["start"] >= 0) & (s["end"] > s["start"])
        rival = F.get(F.filter(acc["kept"], lambda k: overlap(k, s)), F.lit(0))
        weak = F.struct(acc["kept"].alias("kept"), F.concat(acc["dropped"], F.array(_noted(s, "below_min_confidence"))).alias("dropped"))
        free = F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), acc["dropped"].alias("dropped"))
        won = F.struct(F.transform(acc["kept"], lambda k: F.when(k == rival, s).otherwise(k)).alias("kept"), F.concat(acc["dropped"], F.array(_noted(rival, "overlap_lost"))).alias("dropped"))
        lost = F.struct(acc["kept"].alias("kept"), F.concat(acc["dropped"], F.array(_noted(s, "overlap_lost"))).alias("dropped"))
        return F.when(~valid, acc).when(s["conf"] < least, weak).when(rival.isNull(), free).when(_better(s, rival), won).otherwise(lost)

    out = F.aggregate(ordered(spans.cast(SPANS)), start, step)
    return F.struct(ordered(out["kept"]).alias("kept"), out["dropped"].alias("dropped"))


def of_types(spans: Column, types: Column) -> Column:
    """Spans whose type a policy allows; no list or an empty one allows all."""
    return F.filter(spans, lambda s: F.coalesce(F.size(types) < 1, F.lit(True)) | F.array_contains(types, s["type"]))


def of_date_mode(spans: Column, mode: Column) -> Column:
    """Under anchor_only, dates stay only with an anchor of their own."""
    return F.filter(spans, lambda s: (F.coalesce(mode, F.lit("pii_context")) != "anchor_only") | ~s["type"].isin("DOB", "ISSUE_DATE") | s["reason"].contains("_anchor"))


def distinct_spans(spans: Column) -> Column:
    """One span for each (start, end, type), the first."""
    empty = F.array().cast(SPANS)
    return F.aggregate(spans, empty, lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] == s["start"]) & (k["end"] == s["end"]) & (k["type"] == s["type"])), acc).otherwise(F.concat(acc, F.array(s))))


def merged(spans: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Spans of one type whose distance is at most `gap` become one: gaps and islands over (start_byte, end_byte)."""
    by = Window.partitionBy(*keys, "type").orderBy("start_byte", "end_byte")
    reach = F.max("end_byte").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start_byte") > reach + gap), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", island).groupBy(*keys, "type", "island").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.count("*").alias("n_merged")).drop("island")


def counts_by_type(spans: Column) -> Column:
    """A map from type to number of spans."""
    types = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"])))
    return F.map_from_arrays(types, F.transform(types, lambda k: F.size(F.filter(spans, lambda s: s["type"] == k))))


def exploded(df: DataFrame, spans: str, *keys: str) -> DataFrame:
    """One row for each span, with its place in the array."""
    return df.select(*keys, F.posexplode(spans).alias("pos", "s")).select(*keys, "pos", "s.*")


__all__ = ["SPAN", "counts_by_type", "distinct_spans", "exploded", "merged", "of_date_mode", "of_types", "ordered", "overlap", "priority", "resolved"]

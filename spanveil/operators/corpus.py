"""Building and checking labelled corpora: merging, sampling, tallies, captures, sentence carriers, injection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.schema import ALL_TYPES

SOURCES = ("synthetic", "wikipedia", "hf_ru_pii", "reviews", "ai4privacy")


def record_fault(sample_id: Column, text: Column, source: Column, spans: Column) -> Column:
    """The first fault of a corpus record, NULL for a sound one. Repeated ids are found by `first_by_id`."""
    raw = F.to_binary(text, F.lit("utf-8"))
    bad_bounds = F.exists(spans, lambda s: (s["start_byte"] < 0) | (s["end_byte"] <= s["start_byte"]) | (s["end_byte"] > F.octet_length(text)))
    bad_slice = F.exists(spans, lambda s: ~F.is_valid_utf8(F.substring(raw, s["start_byte"] + 1, s["end_byte"] - s["start_byte"]).cast("string")))
    bad_type = F.exists(spans, lambda s: ~s["type"].isin(list(ALL_TYPES)))
    return (
        F.when(sample_id.isNull() | (sample_id.cast("string") == ""), "empty_id").when(F.coalesce(text, F.lit("")) == "", "empty_text")
        .when(~F.coalesce(source, F.lit("")).isin(list(SOURCES)), "unknown_source").when(bad_bounds, "bounds").when(bad_slice, "undecodable").when(bad_type, "unknown_type")
    )


def first_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each id: a grouped minimum, combined before the shuffle, so a hot id stays small."""
    rest = [c for c in df.columns if c not in (key, *order)]
    first = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_x")) if rest else df.groupBy(key).agg(F.min(F.struct(*order)).alias("_x"))
    return first.select(key, "_x.*").select(*df.columns)


def merged(parts: list[tuple[str, DataFrame]], key: str, order: str) -> DataFrame:
    """Corpora put together; each fills its default source; of a repeated id the row of the first corpus stays."""
    out = None
    for n, (default, df) in enumerate(parts):
        x = df.withColumn("source", F.coalesce(F.col("source"), F.lit(default))).withColumn("_file", F.lit(n))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return first_by_id(out, key, ["_file", order]).drop("_file")


def round_robin(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows, one from each group in turn. Only the first n of a group can be taken, and Spark prunes the ranking to
    them before the shuffle (a window group limit)."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", F.col(by).asc_nulls_first(), order).limit(n)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that depends on seed and id only."""
    return df.orderBy(shuffle_key(key, seed), key)


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))


def holdout(number: Column) -> Column:
    """Three of twenty rows, by their number."""
    return F.pmod(number * 7 + 3, F.lit(20)) < 3


def category_plan(weights: dict[str, int], n: int, negative_share: float = 0.14, long: tuple[str, ...] = (), long_cap: int = 4) -> dict[str, int]:
    """How many samples each category gets: in proportion, the remainder to the largest, a share for negatives
    (`neg_`), at most `long_cap` of each long category."""
    negative = {k: w for k, w in weights.items() if k.startswith("neg_")}
    positive = {k: w for k, w in weights.items() if k not in negative}
    out: dict[str, int] = {}
    for group, size in ((negative, int(n * negative_share) if negative else 0), (positive, n - (int(n * negative_share) if negative else 0))):
        total = sum(group.values())
        for k in sorted(group):
            out[k] = size * group[k] // total if total else 0
            if k in long:
                out[k] = min(out[k], long_cap)
        free = [k for k in sorted(group, key=lambda k: (-group[k], k)) if k not in long]
        for i in range(size - sum(out[k] for k in group) if free else 0):
            out[free[i % len(free)]] += 1
    return out


def tallies(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def capture_corpus(captures: DataFrame, texts: DataFrame) -> DataFrame:
    """Masked requests with their text, one row for each text: the earliest. Captures refer to texts by payload_id."""
    mask = captures.where(F.col("direction").startswith("mask") & F.col("payload_id").isNotNull())
    first = mask.groupBy("payload_id").agg(F.min(F.struct("captured_at", "capture_id", "system_id")).alias("x"))
    body = texts.where(F.coalesce(F.col("text"), F.lit("")) != "").groupBy("payload_id").agg(F.min(F.struct("sample_id", "text")).alias("s"))
    return first.join(body, "payload_id").select("payload_id", "x.*", F.col("s.text").alias("text"))


def capture_report(captures: DataFrame) -> DataFrame:
    """By direction: rows, shortest, longest and mean length, rows without a finding, findings."""
    found = F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return captures.groupBy("direction").agg(
        F.count("*").alias("n"), F.min("payload_len").alias("shortest"), F.max("payload_len").alias("longest"), F.round(F.avg("payload_len"), 4).alias("mean_length"),
        F.sum(F.when(F.size(F.coalesce(F.map_keys("counts"), F.array().cast("array<string>"))) == 0, 1).otherwise(0)).alias("no_finding"), F.sum(F.coalesce(found, F.lit(0))).alias("findings"),
    )


def findings_by_type(captures: DataFrame) -> DataFrame:
    return captures.where(F.col("counts").isNotNull()).select(F.explode("counts").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("findings"))


def carriers(pages: DataFrame, key: str, text: str, per_page: int, shortest: int = 40, longest: int = 300) -> DataFrame:
    """Sentences fit to carry labelled values: of the right length, without digits or addresses, once each, the first
    `per_page` of a page; others get the reason they are left out."""
    s = pages.select(key, F.posexplode(t.sentences(F.col(text))).alias("pos", "sentence"))
    reason = F.when(F.length("sentence") < shortest, "short").when(F.length("sentence") > longest, "long").when(F.col("sentence").rlike("[0-9@]"), "has_value").when(~F.col("sentence").rlike(r"[.!?]$"), "unfinished")
    s = s.withColumn("reason", reason)
    good = s.where(F.col("reason").isNull()).groupBy("sentence").agg(F.min(F.struct(key, "pos")).alias("x")).select("x.*", "sentence")
    w = Window.partitionBy(key).orderBy("pos")
    return good.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_page).drop("n")


def fragmented(text: Column, shortest: int = 40, longest: int = 300) -> Column:
    """A text's sentences packed into pieces of `shortest` to `longest` characters, in order."""
    empty = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc, s):
        both = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        full = (F.length(both) > longest) & (F.length(acc["open"]) >= shortest)
        return F.when(full, F.struct(s.alias("open"), F.concat(acc["done"], F.array(acc["open"])).alias("done"))).otherwise(F.struct(both.alias("open"), acc["done"].alias("done")))

    return F.aggregate(t.sentences(text), empty, step, lambda a: F.when(F.length(a["open"]) >= shortest, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def injected(carriers_df: DataFrame, key: str, text: str, values: list[tuple[str, str]], spans: str | None = None) -> DataFrame:
    """A made-up value put into each text at a word boundary, chosen by the id, with its span in bytes. Spans that a text
    has already (column `spans`) stay whole and are moved along. `values` is a parameter of bounded size: (type, value)."""
    kind = carriers_df.schema[key].dataType.simpleString()
    layout = "array<struct<start_byte:int,end_byte:int,type:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from spanveil.operators.synthetic import fnv64

        span = pa.list_(pa.struct([("start_byte", pa.int32()), ("end_byte", pa.int32()), ("type", pa.string())]))
        for b in batches:
            texts, all_spans = [], []
            for i, x, old in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = fnv64(str(i))
                typ, value = values[h % len(values)]
                raw = (x or "").encode()
                old = old or []
                places = [k + 1 for k, c in enumerate(raw) if c == 32 and not any(s["start_byte"] < k + 1 < s["end_byte"] for s in old)] or [0]
                at = places[(h >> 20) % len(places)]
                put = (value + " ").encode()
                texts.append((raw[:at] + put + raw[at:]).decode())
                moved = [{**s, "start_byte": s["start_byte"] + len(put), "end_byte": s["end_byte"] + len(put)} if s["start_byte"] >= at else s for s in old]
                all_spans.append(sorted([*moved, {"start_byte": at, "end_byte": at + len(put) - 1, "type": typ}], key=lambda s: s["start_byte"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(all_spans, span)], names=[key, "text", "spans"])

    have = (F.lit(None) if spans is None else F.col(spans)).cast(layout).alias("spans")
    return carriers_df.select(key, F.col(text), have).mapInArrow(run, f"`{key}` {kind}, text string, spans {layout}")

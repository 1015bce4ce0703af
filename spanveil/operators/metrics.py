"""Metrics of a request log: counters, histograms, sliding load, quantiles, repeats, sampling, redaction of log values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram in milliseconds.
BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 1000.0)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cumulative counts by upper bound, one row for each key and bound, in one aggregation."""
    at = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(BUCKETS)]
    wide = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("total"), *at)
    cells = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)], F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.le", "c.n")


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Rows by status and by its class (2xx, 4xx and so on), with the share of all rows, in one aggregation."""
    g = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return g.select("status", F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")).alias("class"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def sliding_sum(df: DataFrame, ts: str, value: Column, length: str, step: str) -> DataFrame:
    """A sum over windows of `length` that start every `step`."""
    return df.groupBy(F.window(ts, length, step)).agg(F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), "total")


def sliding_quantile(df: DataFrame, ts: str, value: str, q: float, length: str, step: str) -> DataFrame:
    """A quantile over sliding windows from histogram buckets, interpolated within the bucket."""
    bounds = [0.0, *BUCKETS]
    counts = [F.sum(F.when((F.col(value) > lo) & (F.col(value) <= hi), 1).otherwise(0)).alias(f"b{i}") for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
    w = df.where(F.col(value).isNotNull()).groupBy(F.window(ts, length, step)).agg(F.count("*").alias("n"), *counts)
    place = F.lit(q) * F.col("n")
    out, below = F.lit(BUCKETS[-1]), F.lit(0)
    steps = []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        here = F.col(f"b{i}")
        steps.append((below + here >= place, lo + (hi - lo) * (place - below) / F.greatest(here, F.lit(1))))
        below = below + here
    for condition, value_ in reversed(steps):
        out = F.when(condition, value_).otherwise(out)
    return w.select(F.col("window.start").alias("window_start"), "n", out.alias("quantile"))


def repeats_suppressed(df: DataFrame, ts: str, keys: list[str], length: str = "10 seconds") -> DataFrame:
    """The first row of each key in a span of time, with how many more there were."""
    g = df.groupBy(F.window(ts, length), *keys).agg(F.min(ts).alias("first_at"), (F.count("*") - 1).alias("suppressed"))
    return g.select(*keys, "first_at", "suppressed")


def sampled(df: DataFrame, number: Column, every: int, bad: Column) -> DataFrame:
    """One in `every` ordinary rows; bad ones all."""
    return df.where(bad | (F.pmod(number, F.lit(every)) == 0))


def redacted_log_value(value: Column) -> Column:
    """A log value with what may be personal replaced: e-mails, six digits or more, two capitalised words, and the end
    of values over 512 bytes."""
    v = F.regexp_replace(value, r"(?<![\p{L}\p{Nd}._+-])[\p{L}\p{Nd}._+-]++@[\p{L}\p{Nd}.-]++", "[email]")
    v = F.regexp_replace(v, r"\+?[0-9](?:[ .()-]?+[0-9]){5,}+", "[number]")
    v = F.regexp_replace(v, r"[А-ЯЁ][а-яё]++\s++[А-ЯЁ][а-яё]++(?:\s++[А-ЯЁ][а-яё]++)?", "[name]")
    v = F.regexp_replace(v, r"\b[A-Z]{2,}\s+[A-Z]{2,}\b", "[name]")
    return F.when(F.octet_length(v) > 512, F.concat(F.substring(v, 1, 128), F.lit("…"))).otherwise(v)


def actor(key: Column) -> Column:
    return F.concat(F.lit("key:"), F.substring(F.sha2(key, 256), 1, 16))


def capacity_ratio(n_bytes: Column, cores: int, seconds: float) -> Column:
    """The share of `cores` that texts of so many bytes take within a span of time."""
    from spanveil.functions.text import core_millis

    return F.sum(core_millis(n_bytes)) / (1000.0 * cores * seconds)

"""Scores of masking against labelled texts, reports, and gates against a baseline."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.operators.masking import spliced
from spanveil.runtime import durable

#: What a quality slice may lose against its baseline, a false-positive rate may gain, and a timing may change.
QUALITY_TOLERANCE, FALSE_TOLERANCE, TIMING_TOLERANCE = 0.005, 0.5, 0.25


def char_span(text: Column, start_byte: Column, end_byte: Column) -> Column:
    """(start, end) in code points of a byte span; NULL outside the text or inside a character."""
    raw = F.to_binary(text, F.lit("utf-8"))
    head = F.substring(raw, F.lit(1), start_byte)
    value = F.substring(raw, start_byte + 1, end_byte - start_byte)
    good = (start_byte >= 0) & (end_byte > start_byte) & (end_byte <= F.octet_length(text)) & F.is_valid_utf8(value.cast("string")) & F.is_valid_utf8(head.cast("string"))
    a = F.length(head.cast("string"))
    return F.when(good, F.struct(a.alias("start"), (a + F.length(value.cast("string"))).alias("end")))


def changed_share(original: Column, changed: Column, start: Column, end: Column) -> Column:
    """The share of characters of a span that masking changed; 1 if the text's length changed."""
    a, b = F.split(t.cut(original, start, end), ""), F.split(t.cut(changed, start, end), "")
    n = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    return F.when(F.length(original) != F.length(changed), 1.0).otherwise(n / F.greatest(end - start, F.lit(1)))


def outside_changes(original: Column, changed: Column, gold: Column) -> Column:
    """Changed characters outside all labelled spans; NULL if the length changed."""
    # The labelled characters are cut out of both texts first, so the cost is that of the text plus that of the labels.
    by = F.array_sort(gold, lambda a, b: a["start"] - b["start"])
    parts = F.transform(by, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.lit("").alias("put")))
    a, b = (F.split(spliced(x, parts), "") for x in (original, changed))
    return F.when(F.length(original) == F.length(changed), F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)))


def scored(fragments: DataFrame) -> DataFrame:
    """Fragments (type, category, source, share) summed up by type, by category, by source and in all, in one pass."""
    agg = [
        F.count("*").alias("fragments"), F.round(F.avg("share"), 6).alias("mean_share"), F.sum(F.when(F.col("share") > 0, 1).otherwise(0)).alias("touched"),
        F.sum(F.when(F.col("share") == 0, 1).otherwise(0)).alias("missed"), F.sum(F.when((F.col("share") > 0) & (F.col("share") < 1), 1).otherwise(0)).alias("partial"),
        F.sum(F.when(F.col("share") == 1, 1).otherwise(0)).alias("full"),
    ]
    keys = [F.col("type"), F.col("category"), F.col("source")]
    out = fragments.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(F.grouping_id().alias("g"), *agg)
    slice_ = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "category").when(F.col("g") == 6, "source").otherwise("all")
    return out.select(slice_.alias("slice"), F.coalesce("type", "category", "source", F.lit("(none)")).alias("name"), "fragments", "mean_share", "touched", "missed", "partial", "full")


def normalized_levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at place int(q (n - 1)) of the sorted array."""
    return F.element_at(F.array_sort(values), (F.floor(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def exact_quantiles(df: DataFrame, key: str, value: str, qs: tuple[float, ...]) -> DataFrame:
    """Nearest-rank quantiles of each key. Counts of distinct values are summed up in classes of about equal size on a
    logarithmic scale, a few thousand for each key whatever its rows; only the classes in which a quantile lies are then
    ranked, so no task holds a key."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).count()
    v = F.col(value).cast("double")
    counted = durable(counted.withColumn("class", (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 64)).cast("int")))
    over = Window.partitionBy(key)
    classes = counted.groupBy(key, "class").agg(F.sum("count").alias("c"))
    classes = classes.withColumn("n", F.sum("c").over(over)).withColumn("below", F.sum("c").over(over.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    place = lambda q: F.floor(F.lit(q) * (F.col("n") - 1)) + 1
    here = [(F.col("below") < place(q)) & (place(q) <= F.col("below") + F.col("c")) for q in qs]
    wanted = classes.where(functools.reduce(lambda a, b: a | b, here)).select(key, "class", "n", "below")
    a, b = counted.alias("a"), wanted.alias("b")
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("a.class") == F.col("b.class"))
    joined = a.join(b, same).select(f"a.{key}", "a.class", f"a.{value}", "a.count", "b.n", "b.below")
    ranked = joined.withColumn("hi", F.col("below") + F.sum("count").over(Window.partitionBy(key, "class").orderBy(value)))
    least = [F.min(F.when(F.col("hi") >= place(q), F.col(value))).alias(f"p{int(q * 100)}") for q in qs]
    return ranked.groupBy(key).agg(F.max("n").alias("n"), *least)


def longest_bad_run(df: DataFrame, keys: list[str], order: list[str], state: Column, chunk: Column | None = None) -> DataFrame:
    """The longest run of bad rows; rows that are neither good nor bad do not break it (state: good, bad, neutral).

    `chunk` parts a key's rows in their order (by default, the hour of the first order column where that is a time): each
    part is gone through by itself and gives one row (its longest run, the runs at its two ends), and these rows are put
    together, so a hot key is spread over as many tasks as it has parts."""
    if chunk is None:
        chunk = F.date_trunc("hour", F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith("timestamp") else F.lit(0)
    parts = [*keys, "_chunk"]
    w = Window.partitionBy(*parts).orderBy(*order)
    marked = df.withColumn("s", state).where("s <> 'neutral'").withColumn("_chunk", chunk).withColumn("block", F.sum(F.when(F.col("s") == "good", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = marked.groupBy(*parts, "block").agg(F.sum(F.when(F.col("s") == "bad", 1).otherwise(0)).alias("run"))
    ends = blocks.groupBy(*parts).agg(F.max("run").alias("best"), F.max("block").alias("goods"), F.max(F.when(F.col("block") == 0, F.col("run"))).alias("head"), F.max_by("run", "block").alias("tail"))
    rows = F.array_sort(F.collect_list(F.struct("_chunk", "best", "goods", F.coalesce("head", F.lit(0)).alias("head"), "tail")))

    def step(acc, x):
        # A part without a good row lets a run pass through.
        through = acc["open"] + x["head"]
        return F.struct(F.greatest(acc["best"], x["best"], through).alias("best"), F.when(x["goods"] == 0, through).otherwise(x["tail"]).alias("open"))

    zero = F.struct(F.lit(0).cast("bigint").alias("best"), F.lit(0).cast("bigint").alias("open"))
    out = ends.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.aggregate("rows", zero, step, lambda a: a["best"]).alias("longest"))
    return out.where("longest > 0")


def worst_examples(fragments: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n fragments of each group that masking changed least; the limit is the feature. Spark prunes the ranking to
    the first n of a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy("share", *[c for c in fragments.columns if c not in (*keys, "share")])
    return fragments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Characters up to which two texts of different lengths are aligned.
ALIGNED = 1500


def mask_share(original: str | None, masked: str | None) -> float | None:
    """The share of a value that masking hides. Of equal length in bytes: the characters that differ by place. Else the part
    outside the longest common subsequence; of values too long to align, 1 if the original is gone and 0 if it stands
    in the result. NULL without an original; an empty original is hidden."""
    if original is None:
        return None
    if not original:
        return 1.0
    masked = masked or ""
    if len(original.encode()) == len(masked.encode()) and len(original) == len(masked):
        return sum(a != b for a, b in zip(original, masked)) / len(original)
    if max(len(original), len(masked)) > ALIGNED:
        return 0.0 if original in masked else 1.0
    # One row of the alignment is a number whose bits tell where the length of the common part rises.
    where: dict[str, int] = {}
    for i, c in enumerate(original):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(original)) - 1
    for c in masked:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 1 - (len(original) - bin(row).count("1")) / len(original)


def mask_score(original: Column, masked: Column) -> Column:
    """Column form of `mask_share`; values of equal length are compared inside the JVM, where no alignment is needed."""

    @F.arrow_udf("double")
    def aligned(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([mask_share(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return aligned(original, masked)


def false_rates(negatives: DataFrame, key: str, text: str, kept: str) -> DataFrame:
    """name and percent of characters covered by findings, for texts that hold no personal data, by category."""
    covered = F.aggregate(kept, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    g = negatives.groupBy(F.col(key).alias("name")).agg(F.sum(covered).alias("c"), F.sum(F.length(text)).alias("n"))
    return g.select("name", (100.0 * F.coalesce("c", F.lit(0)) / F.greatest("n", F.lit(1))).alias("percent"))


def false_gate(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rates of false findings (name, percent) against a baseline: ok, worse by FALSE_TOLERANCE points, new, or missing."""
    j = now.select("name", F.col("percent").alias("now")).join(baseline.select("name", F.col("percent").alias("before")), "name", "full_outer")
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("before").isNull(), "new").when(F.col("now") > F.col("before") + FALSE_TOLERANCE, "worse").otherwise("ok")
    return j.withColumn("verdict", verdict)


def quality_gate(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(slice, name, mean_share) against a baseline: ok, worse, new, or missing, which fails."""
    j = now.select("slice", "name", F.col("mean_share").alias("now")).join(baseline.select("slice", "name", F.col("mean_share").alias("before")), ["slice", "name"], "full_outer")
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("before").isNull(), "new").when(F.col("now") < F.col("before") - QUALITY_TOLERANCE, "worse").otherwise("ok")
    return j.withColumn("verdict", verdict)


def timing_gate(now: DataFrame, baseline: DataFrame) -> DataFrame:
    j = now.select("name", F.col("ns").alias("now")).join(baseline.select("name", F.col("ns").alias("before")), "name", "full_outer")
    ratio = F.col("now") / F.col("before")
    return j.withColumn("verdict", F.when(ratio.isNull(), "missing").when(ratio > 1 + TIMING_TOLERANCE, "slower").when(ratio < 1 - TIMING_TOLERANCE, "faster").otherwise("ok"))

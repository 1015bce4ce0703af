"""The whole path of a text: findings, policy filters, exclusions, resolution, masking. At most one Arrow boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.operators import masking, onepass, patterns, spans, words
from spanveil.runtime import spread
from spanveil.schema import ALL_TYPES, SPANS

NUMERIC, DOCUMENTS, EXTRAS = words.NUMERIC, words.DOCUMENTS, words.EXTRAS
WORDS = ("FIO", "DOB", "ISSUE_DATE", "ADDRESS", "BIRTH_PLACE", "ISSUER", "CITIZENSHIP", "CARDHOLDER")


def detected(df: DataFrame, text: str, types: tuple[str, ...] = ALL_TYPES, custom: tuple[patterns.CustomType, ...] = (), as_of_year: int = 2026, date_mode: str = "pii_context", into: str = "spans") -> DataFrame:
    """`df` with all findings. Readers none of whose types are wanted do not run. NULL and empty texts have an empty
    array."""
    out = spread(df)
    none = F.array().cast(SPANS)
    wanted = tuple(types)
    if not custom:
        return out.withColumn(into, words.found_spans(F.col(text), wanted, as_of_year, date_mode))
    low = t.lower_same_width(F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_low", low).withColumn("_found", words.found_spans(F.col(text), wanted, as_of_year, date_mode) if wanted else none)
    parts = [F.col("_found"), *[F.coalesce(patterns.custom_spans(F.col("_low"), c), none) for c in custom]]
    return out.withColumn(into, F.concat(*parts)).drop("_low", "_found")


def settled(df: DataFrame, spans_col: str = "spans", min_conf: Column | float = 0.6, allowed: Column | None = None, date_mode: Column | None = None) -> DataFrame:
    """Type filter, date mode, resolution: adds `kept` and `dropped`."""
    s = F.col(spans_col)
    if allowed is not None:
        s = spans.of_types(s, allowed)
    if date_mode is not None:
        s = spans.of_date_mode(s, date_mode)
    return df.withColumn("_r", spans.resolved(s, min_conf)).withColumn("kept", F.col("_r.kept")).withColumn("dropped", F.col("_r.dropped")).drop("_r")


def mask(df: DataFrame, text: str, preset: str | Column = "full", types: tuple[str, ...] = ALL_TYPES, min_conf: float | Column = 0.6, custom: tuple[patterns.CustomType, ...] = (), allowed: Column | None = None, date_mode: Column | None = None) -> DataFrame:
    """`df` with masked, placeholders, counts, kept, dropped and degraded. NULL stays NULL. Preset, confidence, allowed
    types and date mode may be columns, so each row can have its own policy. Types of the user's own are found inside the
    JVM and masked there, too."""
    if custom:
        out = settled(detected(df, text, types, custom), "spans", min_conf, allowed, date_mode)
        out = out.withColumn("degraded", F.exists("spans", lambda s: s["reason"] == "failed"))
        if preset == "synthetic":
            out = masking.mask_synthetic(out, text, "kept").withColumn("placeholders", F.lit(None).cast("array<struct<token:string,value:string,type:string>>"))
        else:
            out = out.withColumn("_m", masking.masked(F.col(text), F.col("kept"), F.lit(preset) if isinstance(preset, str) else preset)).withColumn("masked", F.col("_m.text")).withColumn("placeholders", F.col("_m.placeholders")).drop("_m")
        return out.withColumn("counts", spans.counts_by_type(F.col("kept"))).drop("spans")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = spread(df).withColumn("_p", onepass.one_pass(F.col(text), as_column(preset), as_column(min_conf), allowed, date_mode, tuple(types)))
    out = out.select("*", *[F.col(f"_p.{c}").alias(c) for c in ("kept", "dropped", "masked", "placeholders", "degraded")]).drop("_p")
    return out.withColumn("counts", spans.counts_by_type(F.col("kept")))


def explain(df: DataFrame, doc_id: str, text: str, **kw) -> DataFrame:
    """One row for each finding, kept or dropped, with bytes, value, confidence and reason."""
    out = mask(df.select(doc_id, text), text, **kw)
    both = out.select(doc_id, text, F.explode(F.concat(F.transform("kept", lambda s: F.struct(s.alias("s"), F.lit("kept").alias("status"))), F.transform("dropped", lambda s: F.struct(s.alias("s"), F.lit("dropped").alias("status"))))).alias("x"))
    s = F.col("x.s")
    return both.select(doc_id, "x.status", s["type"].alias("type"), s["start"].alias("start_char"), s["end"].alias("end_char"), t.byte_offset(F.col(text), s["start"]).alias("start_byte"), t.byte_offset(F.col(text), s["end"]).alias("end_byte"), t.cut(F.col(text), s["start"], s["end"]).alias("value"), s["conf"].alias("conf"), s["reason"].alias("reason"))

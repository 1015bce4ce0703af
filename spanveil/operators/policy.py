"""Policies of consuming systems: defaults, validation, listing, the matrix of what is masked how, and edits. A policy
table has a row for each system, so it is small: joins broadcast it behind a check of its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.patterns import CustomType
from spanveil.schema import ALL_TYPES, tier

PRESETS = ("full", "full_ws", "partial", "initials", "token", "synthetic")
DATE_MODES = ("pii_context", "anchor_only", "any", "all")
#: Policies are broadcast up to this many rows.
BROADCAST_ROWS = 100_000


def with_defaults(systems: DataFrame) -> DataFrame:
    """System value, else default: preset full, confidence 0.6, dates by context, 404 for unknown ids, all types."""
    return systems.select(
        "system_id", F.coalesce("preset", F.lit("full")).alias("preset"), F.coalesce("min_conf", F.lit(0.6)).alias("min_conf"), F.coalesce("date_mode", F.lit("pii_context")).alias("date_mode"),
        F.coalesce("on_unknown_id", F.lit("404")).alias("on_unknown_id"), F.coalesce("types", F.array().cast("array<string>")).alias("types"),
    )


def faults(systems: DataFrame) -> DataFrame:
    """Policies that cannot be run, with the reason."""
    s = with_defaults(systems)
    unknown = F.filter("types", lambda k: ~k.isin(list(ALL_TYPES)))
    why = F.when(~F.col("preset").isin(list(PRESETS)), "preset").when(~F.col("min_conf").between(0, 1), "min_conf").when(~F.col("date_mode").isin(list(DATE_MODES)), "date_mode").when(~F.col("on_unknown_id").isin("404", "passthrough"), "on_unknown_id").when(F.size(unknown) > 0, "types")
    return s.withColumn("fault", why).where("fault is not null").select("system_id", "fault")


def joined(rows: DataFrame, systems: DataFrame, key: str = "system_id") -> DataFrame:
    """Rows with the policy of their system; rows of unknown systems get the defaults."""
    s = with_defaults(systems)
    if s.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        s = F.broadcast(s)
    out = rows.join(s.withColumnRenamed("system_id", key), key, "left")
    return out.fillna({"preset": "full", "min_conf": 0.6, "date_mode": "pii_context", "on_unknown_id": "404"}).withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def coverage(systems: DataFrame) -> DataFrame:
    """One row for each system and type: its tier and the preset, or off."""
    spark = systems.sparkSession
    types = F.broadcast(spark.createDataFrame([(k, tier(k)) for k in ALL_TYPES], "type string, tier string"))  # one row for each known type
    s = with_defaults(systems)
    cell = F.when((F.size("types") == 0) | F.array_contains("types", F.col("type")), F.col("preset")).otherwise("off")
    return s.join(types, F.lit(True)).select("system_id", "type", "tier", cell.alias("cell"))


def coverage_wide(systems: DataFrame) -> DataFrame:
    return coverage(systems).groupBy("system_id").pivot("type", list(ALL_TYPES)).agg(F.first("cell"))


def set_types(systems: DataFrame, system_id: str, types: list[str]) -> DataFrame:
    unknown = [k for k in types if k not in ALL_TYPES]
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return _set(systems, system_id, "types", F.array(*[F.lit(k) for k in types]).cast("array<string>"))


def set_preset(systems: DataFrame, system_id: str, preset: str) -> DataFrame:
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    return _set(systems, system_id, "preset", F.lit(preset))


def _set(systems: DataFrame, system_id: str, column: str, value: Column) -> DataFrame:
    return systems.withColumn(column, F.when(F.col("system_id") == system_id, value).otherwise(F.col(column)))


def set_enabled(systems: DataFrame, system_id: str, enabled: bool) -> DataFrame:
    """A system switched on or off; systems without the column are on."""
    return _set(_with(systems, "enabled", F.lit(True)), system_id, "enabled", F.lit(enabled))


def set_allowed(systems: DataFrame, system_id: str, values: list[str]) -> DataFrame:
    """The persons and values that a system lets through, blanks and repeats taken out."""
    clean = list(dict.fromkeys(v.strip() for v in values if v.strip()))
    none = F.array().cast("array<string>")
    return _set(_with(systems, "allowed", none), system_id, "allowed", F.array(*[F.lit(v) for v in clean]).cast("array<string>"))


def _with(systems: DataFrame, column: str, default: Column) -> DataFrame:
    return systems if column in systems.columns else systems.withColumn(column, default)


RULES = "name string, pattern string, group int, anchors array<string>, window int, validator string"


def rules_table(spark, rules: list[CustomType]) -> DataFrame:
    for r in rules:
        r.check()
    return spark.createDataFrame([(r.name.upper(), r.pattern, r.group, list(r.anchors), r.window, r.validator) for r in rules], RULES)


def add_type(rules: DataFrame, rule: CustomType) -> DataFrame:
    """The rules with one more type of the user's own, or another in the place of that name. What cannot be run is refused."""
    rule.check()
    if rule.name.upper() in ALL_TYPES:
        raise ValueError(f"{rule.name} is a type of its own already")
    return remove_type(rules, rule.name).unionByName(rules_table(rules.sparkSession, [rule]))


def remove_type(rules: DataFrame, name: str) -> DataFrame:
    return rules.where(F.col("name") != name.upper())


def custom_types(rules: DataFrame) -> tuple[CustomType, ...]:
    """The rules as detectors, by name; a table of rules is a configuration of bounded size."""
    rows = rules.orderBy("name").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError("more rules than one plan can hold")
    return tuple(CustomType(r["name"], r["pattern"], r["group"], tuple(r["anchors"] or ()), r["window"], r["validator"]) for r in rows)


MAX_RULES = 200


def listing(systems: DataFrame) -> DataFrame:
    """Systems with their policies, by name."""
    return with_defaults(systems).withColumn("n_types", F.when(F.size("types") == 0, len(ALL_TYPES)).otherwise(F.size("types"))).orderBy("system_id")

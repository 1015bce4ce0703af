"""Queries of the training-data operators over the test tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import encode, format_copies, leaks, lookalike, pii, quota, structure, stuffing
from spanveil.runtime import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
#: The tables and label columns that sample_targets speaks of.
SAMPLED = (("category", "samples", "sample_id", "category"), ("type", "fragments", "fragment_id", "type"))
PII_TABLES = (("sample", "samples", "sample_id", "text"), ("raw_sample", "raw_samples", "raw_id", "payload"), ("fragment", "fragments", "fragment_id", "value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.copies(table(prepare(spark), sf_dir, "samples"), "sample_id", "payload_id", "text")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.records_with_copies(table(prepare(spark), sf_dir, "samples"), "sample_id", "payload_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.not_prose(table(prepare(spark), sf_dir, "samples"), "sample_id", "text")
    return found.select(F.col("row_id").alias("sample_id"))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.text_statistics(table(prepare(spark), sf_dir, "samples"), "sample_id", "text").withColumnRenamed("row_id", "sample_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    texts = lookalike.look_alike_pairs(table(spark, sf_dir, "samples"), "sample_id", "text")
    values = lookalike.known_value_matches(table(spark, sf_dir, "known_values"), table(spark, sf_dir, "fragments"), "value_id", "fragment_id", "value")
    return _union([x.select(F.lit(n).alias("field_name"), "left_id", "right_id") for n, x in (("text", texts), ("value", values))])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in classes of texts that look the same: linear however many distinct texts a class has."""
    return lookalike.look_alike_classes(table(prepare(spark), sf_dir, "samples"), "sample_id", "text").withColumnRenamed("row_id", "sample_id")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    parts = (("text", "samples", "sample_id", "text"), ("value", "fragments", "fragment_id", "value"))
    return _union([lookalike.consistent_texts(table(spark, sf_dir, t).select(i, c), c).select(F.lit(n).alias("field_name"), F.col(i).alias("row_id"), "form") for n, t, i, c in parts])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _union([pii.found_kinds(table(spark, sf_dir, t), i, c).select(F.lit(n).alias("table_name"), "row_id", "pii_type") for n, t, i, c in PII_TABLES])


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _union([pii.redacted(table(spark, sf_dir, t), i, c).select(F.lit(n).alias("table_name"), "row_id", "redacted", "n_found") for n, t, i, c in PII_TABLES])


def _samples(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, DataFrame]]:
    wanted = table(prepare(spark), sf_dir, "sample_targets").select("field_name", "stratum", "target_permille", "min_rows", "sample_permille")
    out = []
    for n, t, i, c in SAMPLED:
        # One row more than may be: then `plan` refuses the targets instead of losing some.
        mine = [tuple(r) for r in wanted.where(F.col("field_name") == n).drop("field_name").limit(quota.MAX_STRATA + 1).collect()]
        out.append((n, *quota.sample_by_target(table(spark, sf_dir, t), i, c, mine)))
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([r.where("available < wanted and taken < wanted").select(F.lit(n).alias("field_name"), "stratum") for n, _, r in _samples(spark, sf_dir)])


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing to the targets: rows of each stratum that are wanted and not there."""
    return _union([r.select(F.lit(n).alias("field_name"), "stratum", "available", "wanted", F.greatest(F.col("wanted") - F.col("available"), F.lit(0)).alias("missing"), (F.col("taken") <= F.col("available")).alias("drawn_once")) for n, _, r in _samples(spark, sf_dir)])


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and drawn shares of each stratum, in thousandths, and the gap between them."""
    return _union([r.select(F.lit(n).alias("field_name"), "stratum", "taken", "target_share", "share", (F.col("share") - F.col("target_share")).alias("gap")) for n, _, r in _samples(spark, sf_dir)])


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union([s.select(F.lit(n).alias("field_name"), "row_id", "stratum") for n, s, _ in _samples(spark, sf_dir)])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_column(table(prepare(spark), sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return leaks.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(prepare(spark), sf_dir, "documents"), "doc_id", "text")


def p8_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = stuffing.page_curves(table(prepare(spark), sf_dir, "documents"), "doc_id", "text")
    return curves.select(F.col("page").alias("doc_id"), "link_part", "n_words", "function_part", "slope", "residual", "heavy_part")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_statistics, p3_found, p3_classes, p3_forms, p4_found, p4_redacted, p5_found, p5_report, p5_shares, p5_sample, p6_ids, p7_found, p8_found, p8_curves)}

_QUOTA = """
WITH label AS (
  SELECT 'category' AS field_name, CASE WHEN coalesce(trim(category), '') = '' THEN 'без категории' ELSE lower(trim(category)) END AS stratum FROM samples
  UNION ALL
  SELECT 'type', CASE WHEN coalesce(trim(type), '') = '' THEN 'без категории' ELSE lower(trim(type)) END FROM fragments
), total AS (SELECT field_name, count(*) AS n FROM label GROUP BY field_name
), have AS (SELECT field_name, stratum, count(*) AS available FROM label GROUP BY field_name, stratum
), report AS (
  SELECT t.field_name, t.stratum, coalesce(h.available, 0)::BIGINT AS available,
         greatest(t.min_rows, (n.n * t.sample_permille * t.target_permille) // 1000000)::BIGINT AS wanted
  FROM sample_targets t JOIN total n USING (field_name) LEFT JOIN have h USING (field_name, stratum)
)
"""
_CANON = r"lower(upper(regexp_replace(nfc_normalize({x}), '[^\p{{L}}\p{{M}}\p{{Nd}}]+', '', 'g')))"
_COPIES = rf"""
WITH RECURSIVE part AS (
  SELECT sample_id, {_CANON.format(x='payload_id')} AS k, {_CANON.format(x='text')} AS plain,
         list_filter(regexp_split_to_array(text, '[;|\n\r\x0b\x0c\x85\x{{2028}}\x{{2029}}]+'), lambda x: trim(x) <> '') AS fields
  FROM samples WHERE payload_id <> '' AND text <> ''
), keyed AS (
  SELECT sample_id, k || chr(3) || plain AS plain,
         CASE WHEN len(fields) >= 3 AND list_bool_and(list_transform(fields, lambda x: regexp_matches(x, '(?s)^[^\p{{L}}\p{{Nd}}:=]*[\p{{L}}\p{{Nd}}][\p{{L}}\p{{M}}\p{{Nd}}.\-_''’/№]*(?:\s+[\p{{L}}\p{{Nd}}][\p{{L}}\p{{M}}\p{{Nd}}.\-_''’/№]*)?\s*[:=]\s*\S.*$')))
              THEN k || chr(3) || array_to_string(list_sort(list_transform(fields, lambda x:
                {_CANON.format(x="regexp_extract(x, '(?s)^([^:=]*)[:=]', 1)")} || chr(1) || {_CANON.format(x="regexp_extract(x, '(?s)^[^:=]*[:=](.*)$', 1)")})), chr(2)) END AS form
  FROM part
), canon AS (
  SELECT sample_id, coalesce(min(form) OVER (PARTITION BY plain), plain) AS canon FROM keyed
), record AS (
  SELECT sample_id, min(sample_id) OVER (PARTITION BY canon) AS record_id, count(*) OVER (PARTITION BY canon) AS n_copies FROM canon
)
"""
ORACLES: dict[str, str] = {
    "p1_found": _COPIES + "SELECT record_id, sample_id AS copy_id FROM record WHERE sample_id <> record_id",
    "p1_records": _COPIES + "SELECT record_id, n_copies FROM record WHERE sample_id = record_id UNION ALL SELECT sample_id, 1 FROM samples WHERE coalesce(payload_id = '' OR text = '', true)",
    "p5_found": _QUOTA + "SELECT field_name, stratum FROM report WHERE available < wanted",
    "p5_report": _QUOTA + "SELECT field_name, stratum, available, wanted, greatest(wanted - available, 0) AS missing, true AS drawn_once FROM report",
}

"""Copies of a record hidden by layout: whitespace, letter case, punctuation and field order.

Method. Byte-identical raw rows are collapsed first, with counts. Only the distinct survivors are brought to
canonical text (letters and digits in lower case; a text made wholly of labelled fields also as its sorted fields),
and these are grouped again on the full canonical text, summing the counts. Grouping and checkpoints hold the 256-bit
digest of the whole canonical text in its place, so texts are shuffled once, by the first step only.

Defined results: a row whose key or text is NULL or empty is a record of its own with one copy. Repeated row ids
count as rows. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.runtime import attach, digest, durable

_LABEL_WORD = r"[\p{L}\p{Nd}][\p{L}\p{M}\p{Nd}.\-_'’/№]*"
#: A labelled field: marks, a label of one or two words, `:` or `=`, a value.
FIELD = rf"(?s)^[^\p{{L}}\p{{Nd}}:=]*{_LABEL_WORD}(?:\s+{_LABEL_WORD})?\s*[:=]\s*\S.*$"
#: What parts the fields.
PARTS = r"[;|\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]+"
#: A text counts as made of fields from this many on.
MIN_FIELDS = 3


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def letters_and_digits(text: Column) -> Column:
    """The letters and digits of a text in order, in one case. Combining marks are composed with their letters
    first; only texts that have any pass through Python."""
    marked = text.rlike(r"\p{M}")
    text = F.when(marked, _composed(F.when(marked, text))).otherwise(text)
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{M}\p{Nd}]+", "")))


def _squeezed(text: Column) -> Column:
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{M}\p{Nd}]+", "")))


def field_form(text: Column) -> Column:
    """The sorted fields of a text made wholly of labelled fields, else NULL."""
    parts = F.filter(F.split(text, PARTS), lambda x: F.trim(x) != "")
    fields = F.transform(parts, lambda x: F.concat(_squeezed(F.regexp_extract(x, r"(?s)^([^:=]*)[:=]", 1)), F.lit("\x01"), _squeezed(F.regexp_extract(x, r"(?s)^[^:=]*[:=](.*)$", 1))))
    whole = (F.size(parts) >= MIN_FIELDS) & F.forall(parts, lambda x: x.rlike(FIELD))
    return F.when(whole, F.array_join(F.array_sort(fields), "\x02"))


def canonical_records(df: DataFrame, row_id: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(records, survivors): records has record_id and n_copies by canon_key; survivors one row for each distinct
    raw row as raw_key, canon_key, n_rows. Both are cut from their lineage."""
    k, t = F.col(key), F.col(text)
    rows = df.where((k != "") & (t != ""))
    distinct = rows.groupBy(k.alias("k"), t.alias("t")).agg(F.min(row_id).alias("first_id"), F.count("*").alias("n_rows"))
    shaped = distinct.select("first_id", "n_rows", digest(F.col("k"), F.col("t")).alias("raw_key"), letters_and_digits(F.col("k")).alias("key"), letters_and_digits(F.col("t")).alias("plain"), field_form(F.col("t")).alias("fields"))
    form_key = F.when(F.col("fields").isNotNull(), digest(F.lit("fields"), F.col("key"), F.col("fields")))
    shaped = shaped.select("first_id", "n_rows", "raw_key", digest(F.lit("plain"), F.col("key"), F.col("plain")).alias("plain_key"), form_key.alias("form_key"))
    survivors = durable(shaped)
    # One row for each canonical text; it lists the field forms that share it (more than one only where two texts
    # split the same letters into different fields).
    plain = survivors.groupBy("plain_key").agg(F.min("first_id").alias("first_id"), F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_set("form_key")).alias("forms"))
    plain = plain.withColumn("canon_key", F.coalesce(F.get("forms", F.lit(0)), F.col("plain_key")))
    links = plain.where(F.size("forms") > 1).select(F.col("canon_key").alias("a"), F.explode("forms").alias("b")).where("a <> b").distinct()
    plain = _joined_forms(plain, links)
    canon = durable(plain.select("plain_key", "canon_key", "first_id", "n_rows"))
    records = canon.groupBy("canon_key").agg(F.min("first_id").alias("record_id"), F.sum("n_rows").alias("n_copies"))
    return records, attach_canon(survivors.select("raw_key", "n_rows", "first_id", "plain_key"), canon)


def attach_canon(keyed: DataFrame, canon: DataFrame) -> DataFrame:
    return attach(keyed, canon.select("plain_key", "canon_key", F.col("n_rows").alias("w")), "plain_key", "w")


def _joined_forms(plain: DataFrame, links: DataFrame) -> DataFrame:
    """Brings field forms that share a canonical text to one form, by spreading the smallest form along the links
    until nothing changes. Such links are rare: without any, the plan is left as it is."""
    if not links.limit(1).collect():
        return plain
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    root = durable(ends.select(F.col("a").alias("form")).distinct().withColumn("root", F.col("form")))
    while True:
        near = ends.join(root, ends.b == root.form).groupBy("a").agg(F.min("root").alias("near"))
        step = durable(root.join(near, root.form == near.a, "left").select("form", F.least("root", F.coalesce("near", "root")).alias("root"), (F.col("near") < F.col("root")).alias("moved")))
        root = step.drop("moved")
        if not step.where("moved").limit(1).collect():
            break
    return plain.join(root, plain.canon_key == root.form, "left").withColumn("canon_key", F.coalesce("root", "canon_key")).drop("form", "root")


def records_with_copies(df: DataFrame, row_id: str, key: str, text: str) -> DataFrame:
    """One row per record: record_id (its smallest row id) and n_copies."""
    records, _ = canonical_records(df, row_id, key, text)
    k, t = F.col(key), F.col(text)
    single = df.where(F.coalesce((k == "") | (t == ""), F.lit(True))).select(F.col(row_id).alias("record_id"), F.lit(1).cast("long").alias("n_copies"))
    return records.select("record_id", "n_copies").unionByName(single)


def copies(df: DataFrame, row_id: str, key: str, text: str) -> DataFrame:
    """record_id, copy_id: one row for each row of a set of copies but the smallest."""
    records, survivors = canonical_records(df, row_id, key, text)
    several = records.where("n_copies > 1").select("canon_key", "record_id", "n_copies")
    wanted = attach(survivors, several, "canon_key", "n_copies").select("raw_key", "record_id", "n_rows")
    k, t = F.col(key), F.col(text)
    rows = df.where((k != "") & (t != "")).select(F.col(row_id).alias("copy_id"), digest(k, t).alias("raw_key"))
    return attach(rows, durable(wanted), "raw_key", "n_rows").where("copy_id <> record_id").select("record_id", "copy_id")

"""Writers: answers, datasets, captures, audit rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answers(df: DataFrame, result: str = "masked") -> DataFrame:
    """One JSON answer for each row, without escaping beyond JSON's own."""
    return df.select("payload_id", F.to_json(F.struct(F.col(result).alias("result"))).alias("answer"))


def dataset(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def captures(df: DataFrame, path: str, with_payload: bool = False) -> None:
    """Appends capture rows by day; the payload only where that is allowed."""
    out = df if with_payload else df.drop("payload", "result")
    out.withColumn("day", F.to_date("time")).write.mode("append").partitionBy("day").json(path)


def audit_rows(df: DataFrame, op: str) -> DataFrame:
    """Audit rows: counts, sizes and hashes, never values."""
    return df.select(
        F.lit(op).alias("op"), "system", F.concat(F.lit("id:"), F.substring(F.sha2("payload_id", 256), 1, 12)).alias("payload_id"), F.octet_length("payload").alias("bytes"),
        "counts", F.when(F.col("degraded"), "degraded").otherwise("ok").alias("result"),
    )


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A report table of an aggregate. At most `rows` rows come to the driver; a last line says that there are more."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    got = df.limit(rows + 1).collect()
    more = f"\nOnly the first {rows} rows are shown.\n" if len(got) > rows else ""
    return head + "".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |\n" for r in got[:rows]) + more


def report(df: DataFrame, path: str) -> None:
    """A whole aggregate as JSON lines, written by the executors."""
    df.write.mode("overwrite").json(path)


def exposition(df: DataFrame, name: str, value: str) -> DataFrame:
    """Lines of a metrics page: name, labels from the other columns, value."""
    labels = [c for c in df.columns if c != value]
    parts = [F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels]
    return df.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line"))

"""Readers of labelled corpora, aliased datasets, captures, key-value mappings and configuration."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.operators.patterns import CustomType

LABELLED = "id string, category string, source string, text string, spans array<struct<start:int,end:int,type:string>>, partial_labels boolean"
ALIASED = (
    "id string, payload_id string, text string, payload string, category string, spans array<struct<start:int,end:int,type:string,label:string,value:string,text:string>>, "
    "fragments array<struct<start:int,end:int,type:string,label:string,value:string,text:string>>, entities array<struct<start:int,end:int,type:string,label:string,value:string,text:string>>"
)
CAPTURE = "time timestamp, system string, payload_id string, direction string, payload_len int, counts map<string,int>, took_ms double, payload string, result string"
REQUEST = "payload string, payload_id string"
CHAT = "model string, messages array<struct<role:string,content:string>>, stream boolean, system string"


def labelled(spark: SparkSession, path: str, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Labelled JSON lines; broken lines are left out. The limit is the reader's own option."""
    df = spark.read.schema(LABELLED).option("mode", "DROPMALFORMED").json(path)
    if category:
        df = df.where(F.col("category") == category)
    return df.limit(limit) if limit else df


def with_broken_count(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, one row with the numbers of broken lines and of records)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", LABELLED + ", _broken string", options).alias("r")).select("r.*")
    return lines.where(F.col("_broken").isNull()).drop("_broken"), lines.agg(F.count("_broken").alias("broken_lines"), F.count("id").alias("records"))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array or JSON lines with aliased names; a broken record is an error."""
    first = spark.read.text(path, wholetext=False).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0]["value"].lstrip().startswith("[")
    return aliased(spark.read.schema(ALIASED).option("mode", "FAILFAST").option("multiLine", array).json(path))


def aliased(df: DataFrame) -> DataFrame:
    """payload_id, payload, category and byte spans, whichever of their names a record uses."""
    body = F.coalesce("payload", "text")
    raw = F.coalesce("spans", "fragments", "entities")
    spans = F.transform(raw, lambda s: span_bounds(body, s["start"], s["end"], F.coalesce(s["value"], s["text"]), F.coalesce(s["type"], s["label"])))
    return df.select(F.coalesce("payload_id", "id").alias("payload_id"), body.alias("payload"), "category", F.filter(spans, lambda s: s.isNotNull()).alias("spans"))


def span_bounds(body: Column, start: Column, end: Column, value: Column, kind: Column) -> Column:
    """Byte bounds of a fragment: both given, start and the value's length, or the value's first place. NULL if none
    of these can be had or they lie outside the text."""
    size = F.octet_length(value)
    found = F.when(F.instr(body, value) > 0, t.byte_offset(body, F.instr(body, value) - 1))
    a = F.coalesce(start, found)
    b = F.when(start.isNotNull() & end.isNotNull(), end).otherwise(a + size)
    return F.when((a >= 0) & (b > a) & (b <= F.octet_length(body)), F.struct(a.cast("int").alias("start_byte"), b.cast("int").alias("end_byte"), F.upper(F.trim(kind)).alias("type")))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Masked captures with a payload, the first of each payload."""
    df = spark.read.schema(CAPTURE).option("mode", "DROPMALFORMED").json(path)
    keep = df.where(F.col("direction").startswith("mask") & (F.coalesce("payload", F.lit("")) != ""))
    rest = [c for c in keep.columns if c not in ("payload", "time")]
    first = keep.groupBy("payload").agg(F.min(F.struct("time", *[F.col(c) for c in rest if c != "counts"], F.to_json("counts").alias("counts"))).alias("x"))
    return first.select("payload", "x.*").withColumn("counts", F.from_json("counts", "map<string,int>")).select(*keep.columns)


def requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests of a text column of JSON: both fields must be there, empty ones count as there."""
    r = F.from_json(column, REQUEST)
    return lines.select(r.alias("r")).select("r.payload_id", "r.payload").withColumn("status", F.when(F.col("payload").isNull() | F.col("payload_id").isNull(), 422).otherwise(200))


def chat_turns(lines: DataFrame, conversation: str, column: str = "value") -> DataFrame:
    """One row for each message of chat requests; streamed requests are refused."""
    c = F.from_json(column, CHAT)
    ok = lines.select(conversation, c.alias("c")).where(~F.coalesce(F.col("c.stream"), F.lit(False)))
    return ok.select(conversation, F.posexplode("c.messages").alias("turn", "m")).select(conversation, "turn", "m.role", F.col("m.content").alias("text"))


def parquet_corpus(spark: SparkSession, path: str, text: str = "source_text", language: str = "language") -> DataFrame:
    """The text and language columns of a parquet corpus; nothing else is read."""
    return spark.read.parquet(path).select(F.col(text).alias("text"), F.col(language).alias("language"))


def expanded(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} from the environment."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), text)


def line_list(path: str) -> list[str]:
    """The lines of a list file without comments and blanks."""
    return [x.strip() for x in Path(path).read_text().splitlines() if x.strip() and not x.lstrip().startswith("#")]


def config(path: str, env: dict[str, str] | None = None) -> dict:
    """A JSON configuration (YAML where that library is installed) with environment values put in, types of the user's
    own checked, and list files read."""
    body = expanded(Path(path).read_text(), env)
    if path.endswith((".yaml", ".yml")):
        import yaml

        out = yaml.safe_load(body) or {}
    else:
        out = json.loads(body)
    custom = [CustomType(c["name"], c["pattern"], c.get("group", 0), tuple(c.get("anchors", ())), c.get("window", 40), c.get("validator", "none")) for c in out.get("custom_types", [])]
    for c in custom:
        c.check()
    out["custom_types"] = custom
    for s in out.get("systems", []):
        if "allow_file" in s:
            s["allow"] = line_list(s["allow_file"])
    return out

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from spanveil.operators import corpus, generate, mapping, metrics, pipeline, policy, quality
from spanveil.sources import readers, writers
from spanveil.streaming import requests

KEY = "0123456789abcdef"
def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def test_state_table(spark):
    r = spark.createDataFrame([("a", "s1", "почта a@b.ru")], "payload_id string, system string, payload string")
    store = mapping.mappings_of(pipeline.mask(r, "payload"), KEY, now()).cache()
    mask = store.collect()[0]["mask"]
    broken = store.withColumn("payload_id", F.lit("broken")).withColumn("orig_ct", F.lit(b"x" * 40))
    old = store.withColumn("payload_id", F.lit("old")).withColumn("expires_at", F.lit("2025-01-01").cast("timestamp"))
    store = store.unionByName(broken).unionByName(old)
    asked = [
        ("a", "s1", "почта a@b.ru", "404", "mask_retry"), ("a", "s1", mask, "404", "demask"), ("a", "s2", mask, "404", "forbidden"), ("a", "s1", "другое", "404", "ambiguous"),
        ("n", "s1", "новое", "404", "mask_store"), ("n", "s1", "*****", "404", "not_found"), ("n", "s1", "*****", "passthrough", "passthrough"), ("broken", "s1", "x", "404", "corrupted"), ("old", "s1", "почта a@b.ru", "404", "mask_store"),
    ]
    df = spark.createDataFrame([(*x[:4], i) for i, x in enumerate(asked)], "payload_id string, system string, payload string, on_unknown_id string, i int").withColumn("preset", F.lit("full")).withColumn("demask", F.lit(True))
    got = mapping.routed(df, store, KEY, now()).collect()
    by = {(r["payload_id"], r["system"], r["payload"], r["action"]): r for r in got}
    for p, s, x, _, action in asked:
        assert (p, s, x, action) in by
    assert by[("a", "s1", mask, "demask")]["result"] == "почта a@b.ru" and by[("a", "s2", mask, "forbidden")]["status"] == 403
    assert {r["payload_id"] for r in mapping.upserted(store, store.where("payload_id = 'a'"), now()).collect()} == {"a", "broken"}


def test_streaming_flow(spark, tmp_path):
    at = dt.datetime(2026, 1, 1, 12)
    rows = [("a", "s1", "почта a@b.ru", at), ("a", "s1", "почта a@b.ru", at + dt.timedelta(seconds=5)), ("a", "s1", "почта ******", at + dt.timedelta(seconds=9)), ("b", "s1", "*****", at), ("a", "s2", "почта ******", at + dt.timedelta(seconds=12)), ("a", "s1", "почта a@b.ru", at + dt.timedelta(hours=2))]
    spark.createDataFrame(pd.DataFrame(rows, columns=["payload_id", "system", "payload", "at"])).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("payload_id string, system string, payload string, at timestamp").parquet(str(tmp_path / "in")).withWatermark("at", "10 seconds")
    masked = source.withColumn("masked", F.regexp_replace("payload", r"\S+@\S+", "******"))
    q = requests.flow(masked).writeStream.format("memory").queryName("flow").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["payload_id"], r["system"], r["action"]) for r in spark.table("flow").collect())
    assert got == sorted([("a", "s1", "mask_store"), ("a", "s1", "mask_retry"), ("a", "s1", "demask"), ("b", "s1", "not_found"), ("a", "s2", "forbidden"), ("a", "s1", "mask_store")])


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps([{"id": "1", "text": "тел 123", "fragments": [{"label": "pin", "value": "123"}, {"type": "fio", "start": 0, "end": 99}]}, {"payload_id": "2", "payload": "x", "spans": [{"start": 0, "end": 1, "type": "A"}]}]))
    got = sorted(map(tuple, readers.dataset(spark, str(p)).select("payload_id", "payload", F.to_json("spans")).collect()))
    assert got == [("1", "тел 123", '[{"start_byte":7,"end_byte":10,"type":"PIN"}]'), ("2", "x", '[{"start_byte":0,"end_byte":1,"type":"A"}]')]
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"id":"1","text":"a","spans":[]}\nnot json\n{"id":"2","text":"b","spans":[]}\n')
    good, broken = readers.with_broken_count(spark, str(lines))
    assert broken.collect()[0]["broken_lines"] == 1 and good.count() == 2
    c = tmp_path / "c.json"
    c.write_text('{"systems":[{"name":"${NAME:-x}"}],"custom_types":[{"name":"a","pattern":"z[0-9]+"}]}')
    assert readers.config(str(c), {})["systems"][0]["name"] == "x"
    df = spark.createDataFrame([('{"payload":"","payload_id":"1"}',), ('{"payload":"x"}',)], "value string")
    assert [r["status"] for r in readers.requests(df).collect()] == [200, 422]
    assert "| a |" in writers.markdown(spark.createDataFrame([("a", 1)], "name string, n int"))
    assert writers.exposition(spark.createDataFrame([("s", 2)], "system string, n int"), "m", "n").collect()[0][0] == 'm{system="s"} 2'


def test_scores_and_gates(spark):
    df = spark.createDataFrame([("абвг", "а**г", 0, 4), ("абвг", "аб", 0, 4), ("абвг", "абвг", 1, 3)], "a string, b string, s int, e int")
    assert [r[0] for r in df.select(quality.changed_share(F.col("a"), F.col("b"), F.col("s"), F.col("e"))).collect()] == [0.5, 1.0, 0.0]
    now, base = spark.createDataFrame([("type", "A", 0.9), ("type", "B", 0.5)], "slice string, name string, mean_share double"), spark.createDataFrame([("type", "A", 0.903), ("type", "B", 0.6), ("type", "C", 1.0)], "slice string, name string, mean_share double")
    assert {r["name"]: r["verdict"] for r in quality.quality_gate(now, base).collect()} == {"A": "ok", "B": "worse", "C": "missing"}
    b = spark.createDataFrame([("Привет", 0, 4), ("Привет", 1, 4), ("Привет", 0, 99)], "t string, a int, b int").select(quality.char_span(F.col("t"), F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r["c"]["start"], r["c"]["end"]) if r["c"] else None for r in b] == [(0, 2), None, None]


def test_policies_and_plans(spark):
    s = spark.createDataFrame([("a", "weird", None, None, None, ["CARD"]), ("b", None, 0.9, None, None, ["NOPE"])], "system_id string, preset string, min_conf double, date_mode string, on_unknown_id string, types array<string>")
    assert {(r["system_id"], r["fault"]) for r in policy.faults(s).collect()} == {("a", "preset"), ("b", "types")}
    assert policy.coverage(s).where("system_id = 'a' and cell <> 'off'").count() == 1
    plan = corpus.category_plan({"fio": 3, "card": 1, "long_64k": 50, "neg_a": 1}, 100, long=("long_64k",))
    assert sum(plan.values()) == 100 and plan["neg_a"] == 14 and plan["long_64k"] <= 4


def test_generator_is_deterministic(spark):
    a, b = (generate.generated(spark.newSession(), 200, 7).repartition(n).orderBy("n").collect() for n in (1, 3))
    assert a == b
    for r in a:
        raw = r["text"].encode()
        assert all(raw[s["start_byte"] : s["end_byte"]].decode() for s in r["spans"])


def test_log_values(spark):
    df = spark.createDataFrame([("почта a@b.ru и 8 916 123 45 67",), ("Иван Петров тут",), ("x" * 600,), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(metrics.redacted_log_value(F.col("v"))).collect()]
    assert got[0] == "почта [email] и [number]" and got[1] == "[name] тут" and len(got[2]) == 129 and got[3:] == ["", None]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text string, spans string, kept int, _r int")
    assert pipeline.mask(df.select("text"), "text").count() == 0


def test_streaming_windows(spark, tmp_path):
    at = dt.datetime(2026, 1, 1, 12)
    rows = [("a", "x", 10, at), ("a", "x", 10, at + dt.timedelta(seconds=3)), ("a", "y", 20, at + dt.timedelta(seconds=4)), ("b", "x", 5, at + dt.timedelta(seconds=30))]
    spark.createDataFrame(pd.DataFrame(rows, columns=["payload_id", "payload", "cost", "at"])).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("payload_id string, payload string, cost long, at timestamp").parquet(str(tmp_path / "in"))

    def done(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted((r["payload_id"], r["payload"]) for r in done(requests.coalesced(source()), "coalesced", "append")) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert sum(r["total"] for r in done(requests.load(source(), "cost", "15 seconds", "5 seconds"), "load", "complete")) == 45 * 3
    assert sorted((r["payload"], r["suppressed"]) for r in done(requests.repeats(source(), ["payload"]), "repeats", "complete")) == [("x", 0), ("x", 1), ("y", 0)]

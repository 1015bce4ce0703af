"""Chat requests, answers, scores by alignment, edits of policies and rules, injection beside existing labels, reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanveil.functions.names import declined
from spanveil.operators import chat, corpus, generate, masking, pipeline, policy, quality
from spanveil.operators.patterns import CustomType
from spanveil.sources import writers


def test_requests_and_answers(spark):
    request = {
        "model": "m", "messages": [{"role": "user", "content": "Клиент Иван Петров, тел. +7 916 123-45-67"}, {"role": "user", "content": [{"type": "text", "text": "Иван Петров ждёт"}, {"type": "image", "url": "x"}]}],
        "tools": [{"function": {"name": "f", "description": "почта a@b.ru", "parameters": {"properties": {"title": {"type": "string"}}}}}],
    }
    known = [{"token": "[FIO_4]", "value": "Анна Белова", "type": "FIO"}]
    rows = [(1, json.dumps(request, ensure_ascii=False), known), (2, json.dumps({"messages": [], "stream": True}), None), (3, "no json", None), (4, None, None)]
    df = spark.createDataFrame(rows, "i int, request string, known array<struct<token:string,value:string,type:string>>")
    got = {r["i"]: r for r in chat.masked_requests(df, "request", "known").collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == [200, 400, 422, 422]
    body = json.loads(got[1]["masked"])
    assert body["messages"][0]["content"] == "Клиент [FIO_5], тел. [PHONE_1]" and body["messages"][1]["content"][0]["text"] == "[FIO_5] ждёт"
    assert body["tools"][0]["function"]["description"] == "почта [EMAIL_1]" and body["tools"][0]["function"]["parameters"] == request["tools"][0]["function"]["parameters"]
    assert {p["token"] for p in got[1]["placeholders"]} == {"[FIO_4]", "[FIO_5]", "[PHONE_1]", "[EMAIL_1]"}

    pairs = [{"token": "[FIO_5]", "value": "Иван Петров", "type": "FIO"}, {"token": "Олег Громов", "value": "Пётр Зимин", "type": "FIO"}]
    answer = {"id": "[FIO_5]", "choices": [{"message": {"role": "a", "content": "Передал (FIO_5) и Олегу Громову"}}, {"delta": {"content": "[fio_5]"}}]}
    df = spark.createDataFrame([(json.dumps(answer, ensure_ascii=False), pairs), ("plain", pairs), (None, None)], "answer string, pairs array<struct<token:string,value:string,type:string>>")
    out = [r["restored"] for r in chat.restored_responses(df, "answer", "pairs").collect()]
    back = json.loads(out[0])
    assert back["id"] == "[FIO_5]" and back["choices"][0]["message"]["content"] == "Передал Иван Петров и Пётр Зимин" and back["choices"][1]["delta"]["content"] == "Иван Петров"
    assert out[1:] == ["plain", None] and "Олегу Громову" in declined("Олег Громов")


def test_answers_of_conversations(spark):
    turns = spark.createDataFrame([("c", 1, "Клиент Иван Петров, тел. +7 916 123-45-67"), ("c", 2, "Иван Петров ждёт"), ("d", 1, "Пишите на a@b.ru")], "c string, n int, text string")
    masked = chat.masked_turns(turns, "c", "n", "text")
    answers = spark.createDataFrame([("c", "Передайте [FIO_1]: {PHONE_1}"), ("d", "Пишу на <email_1>"), ("c", "ничего"), ("e", "[FIO_1]"), ("c", None)], "c string, text string")
    out = {(r["c"], r["text"]): r["restored"] for r in chat.restored_answers(answers, masked, "c", "text").collect()}
    assert out == {("c", "Передайте [FIO_1]: {PHONE_1}"): "Передайте Иван Петров: +7 916 123-45-67", ("d", "Пишу на <email_1>"): "Пишу на <email_1>", ("c", "ничего"): "ничего", ("e", "[FIO_1]"): "[FIO_1]", ("c", None): None}


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_mask_share_against_plain_alignment():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abв*") for _ in range(rng.randint(1, 12))) for _ in range(2))
        want = sum(x != y for x, y in zip(a, b)) / len(a) if len(a) == len(b) and len(a.encode()) == len(b.encode()) else 1 - _common(a, b) / len(a)
        assert quality.mask_share(a, b) == pytest.approx(want)
    assert quality.mask_share(None, "x") is None and quality.mask_share("", "x") == 1.0
    assert quality.mask_share("a" * 2000, "xx" + "a" * 2000) == 0.0 and quality.mask_share("a" * 2000, "b") == 1.0


def test_runs_and_quantiles_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice(["good", "bad", "bad", "bad", "neutral"]), rng.choice([None, -3.0, 0.0, rng.random() * 100])) for k in "ab" for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, s string, v double")
    want = {}
    for k in "ab":
        best = run = 0
        for _, _, s, _ in sorted(r for r in rows if r[0] == k):
            run = run + 1 if s == "bad" else 0 if s == "good" else run
            best = max(best, run)
        want[k] = best
    for chunk in (F.lit(0), F.floor(F.col("i") / 3), F.floor(F.col("i") / 50)):
        assert {r["k"]: r["longest"] for r in quality.longest_bad_run(df, ["k"], ["i"], F.col("s"), chunk).collect()} == want
    got = {r["k"]: r for r in quality.exact_quantiles(df, "k", "v", (0.0, 0.5, 0.99)).collect()}
    for k in "ab":
        values = sorted(v for a, _, _, v in rows if a == k and v is not None)
        assert [got[k]["p0"], got[k]["p50"], got[k]["p99"]] == [values[int(q * (len(values) - 1))] for q in (0.0, 0.5, 0.99)]


def test_edits_of_policies_and_rules(spark):
    systems = spark.createDataFrame([("a", "full", 0.6, None, None, ["FIO"]), ("b", None, None, None, None, None)], "system_id string, preset string, min_conf double, date_mode string, on_unknown_id string, types array<string>")
    s = policy.set_allowed(policy.set_enabled(systems, "a", False), "b", [" Пётр ", "Пётр", ""])
    got = {r["system_id"]: (r["enabled"], r["allowed"]) for r in s.collect()}
    assert got == {"a": (False, []), "b": (True, ["Пётр"])}
    rules = policy.rules_table(spark, [CustomType("loan", "кд-[0-9]{4}")])
    rules = policy.add_type(rules, CustomType("tag", "тэг[0-9]+", anchors=("метка",)))
    assert [r.name for r in policy.custom_types(rules)] == ["LOAN", "TAG"] and [r.name for r in policy.custom_types(policy.remove_type(rules, "loan"))] == ["TAG"]
    for bad in (CustomType("x", "(?=a)b"), CustomType("fio", "a")):
        with pytest.raises(ValueError):
            policy.add_type(rules, bad)
    df = spark.createDataFrame([("договор КД-1234",)], "text string")
    assert pipeline.mask(df, "text", custom=policy.custom_types(rules)).collect()[0]["masked"] == "договор *******"


def test_injection_keeps_labels(spark):
    df = spark.createDataFrame([(i, "Клиент Иван Петров ждёт ответа", [{"start_byte": 13, "end_byte": 34, "type": "FIO"}]) for i in range(20)], "i long, text string, spans array<struct<start_byte:int,end_byte:int,type:string>>")
    for r in corpus.injected(df, "i", "text", [("PIN", "1234"), ("CVV", "567")], "spans").collect():
        raw = r["text"].encode()
        values = {s["type"]: raw[s["start_byte"] : s["end_byte"]].decode() for s in r["spans"]}
        assert values.pop("FIO") == "Иван Петров" and set(values.values()) <= {"1234", "567"} and len(r["spans"]) == 2


def test_generated_labels_and_categories():
    rows = [generate.sample(i, 3, False) for i in range(4000)]
    for r in rows:
        raw = r["text"].encode()
        assert all(raw[s["start_byte"] : s["end_byte"]].decode() for s in r["spans"])
        assert not r["spans"] if r["category"].startswith("neg_") else r["spans"]
    assert len(generate.NEGATIVES) == 46 and len(generate.SHAPES) == 20
    assert {k for k in generate.KINDS if k != "single"} <= {r["category"] for r in rows} and {"typos", "noise", "look_alike"} <= {r["category"] for r in rows}
    assert rows[:50] == [generate.sample(i, 3, False) for i in range(50)]


def test_report_says_what_it_leaves_out(spark):
    df = spark.range(5).withColumnRenamed("id", "n").orderBy("n")
    assert "Only the first 3 rows" in writers.markdown(df, 3) and "Only" not in writers.markdown(df, 5)


def test_partial_matches_the_one_pass_form(spark):
    from spanveil.operators import onepass

    values = ["", "a", "ab-cd-ef", "+7 916 123-45-67", "Иванов", "- - -", "абв гдe 12", "x" * 5000]
    rows = spark.createDataFrame([(x,) for x in values], "v string").select("v", masking.partial(F.col("v")).alias("m"), masking.initials(F.col("v")).alias("i")).collect()
    assert all(r["m"] == onepass.partial(r["v"]) and r["i"] == onepass.initials(r["v"]) for r in rows)

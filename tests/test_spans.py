import random

from pyspark.sql import functions as F

from spanveil.operators import spans, subjects
from spanveil.schema import PRIORITY, SPANS


def fold(items, least):
    """The rules in plain Python."""
    kept = []
    for s in sorted(items, key=lambda s: (s[0], -(s[1] - s[0]), -s[3])):
        if not 0 <= s[0] < s[1] or s[3] < least:
            continue
        rival = next((k for k in kept if k[0] < s[1] and s[0] < k[1]), None)
        if rival is None:
            kept.append(s)
        elif (s[1] - s[0], PRIORITY.get(s[2], 0), s[3]) > (rival[1] - rival[0], PRIORITY.get(rival[2], 0), rival[3]):
            kept[kept.index(rival)] = s
    return sorted((s[0], s[1], s[2]) for s in kept)


def resolve(spark, sets, least=0.6):
    df = spark.createDataFrame([(i, [(*s, "r") for s in x]) for i, x in enumerate(sets)], f"i int, s {SPANS}")
    rows = df.select("i", spans.resolved(F.col("s"), least).alias("r")).orderBy("i").collect()
    return [[(k["start"], k["end"], k["type"]) for k in r["r"]["kept"]] for r in rows]


def test_resolution_cases(spark):
    sets = [
        [(0, 5, "FIO", 0.9), (5, 9, "FIO", 0.9)],  # touching: both
        [(0, 10, "FIO", 0.6), (2, 5, "CARD", 0.9)],  # the longer
        [(0, 5, "FIO", 0.9), (0, 5, "CARD", 0.6)],  # the type
        [(0, 5, "X", 0.75), (0, 5, "Y", 0.9)],  # the surer
        [(0, 5, "FIO", 0.6)],  # equality stays
        [(0, 4, "A", 0.9), (3, 9, "B", 0.9), (8, 16, "C", 0.9)],  # a chain leaves the last
        [(5, 5, "FIO", 0.9), (7, 3, "FIO", 0.9)],  # invalid
        [],
    ]
    got = resolve(spark, sets)
    assert got[5] == [(8, 16, "C")] and got[4] == [(0, 5, "FIO")] and got[6] == [] and got[7] == []
    assert [sorted(x) for x in got] == [fold(s, 0.6) for s in sets]


def test_random_sets_are_disjoint(spark):
    r = random.Random(1)
    sets = [[(a := r.randrange(40), a + r.randrange(1, 12), r.choice(["FIO", "CARD", "INN"]), r.choice([0.4, 0.6, 0.9])) for _ in range(r.randrange(8))] for _ in range(300)]
    for got, s in zip(resolve(spark, sets), sets):
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        assert {x[:2] for x in got} == {x[:2] for x in fold(s, 0.6)}


def test_subjects():
    text = "ФИО: Иван\nТелефон: 1\n\nДругое. Иван тут! Конец"
    s = [{"start": 5, "end": 9}, {"start": 19, "end": 20}, {"start": 30, "end": 34}, {"start": 41, "end": 46}]
    got = subjects.link(text, s)
    assert [x["subject"] for x in got] == [0, 0, 0, 3]  # questionnaire, then the repeated value
    assert {(e["a"], e["b"], e["basis"]) for e in subjects.edges_of(text, s)} == {(0, 1, "anchor"), (0, 2, "repeat")}
    assert subjects.link(None, None) == [] and subjects.link("", [{"start": 0, "end": 1}])[0]["subject"] == 0


def test_rules_keep_what_goes_together(spark):
    df = spark.createDataFrame([(1, [(0, 3, "PIN", 0.9, "r"), (5, 9, "CARD", 0.9, "r")], [(0,), (0,)]), (2, [(0, 3, "PIN", 0.9, "r"), (5, 9, "CARD", 0.9, "r")], [(0,), (1,)])], f"i int, s {SPANS}, l array<struct<subject:int>>")
    rules = F.array(F.struct(F.lit("PIN").alias("mask"), F.array(F.lit("CARD")).alias("requires")))
    got = {r["i"]: [x["type"] for x in r["k"]] for r in df.select("i", subjects.required(F.col("s"), F.col("l"), rules).alias("k")).collect()}
    assert got == {1: ["PIN", "CARD"], 2: ["CARD"]}

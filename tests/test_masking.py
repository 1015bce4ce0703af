from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions import validators as v
from spanveil.operators import chat, masking, pipeline, synthetic


def test_presets(spark):
    df = spark.createDataFrame([("Иванов Иван",), ("4509 123456",), ("ab",), ("",), ("Анна-Мария Ли",), (None,)], "x string")
    x = F.col("x")
    got = [tuple(r) for r in df.select(masking.full(x), masking.full_ws(x), masking.partial(x), masking.initials(x)).collect()]
    assert got[0] == ("*" * 11, "****** ****", "Ив**** **ан", "И. И.")
    assert got[1] == ("*" * 11, "**** ******", "45** ****56", "*" * 11)
    assert got[2] == ("**", "**", "**", "A.")
    assert got[3] == ("", "", "", "")
    assert got[4][3] == "А. Л." and got[5] == (None, None, None, None)


def test_round_trip_and_numbering(spark):
    text = "a@b.ru пишет c@d.ru, снова a@b.ru; тел. +7 916 123-45-67"
    df = spark.createDataFrame([(text,), ("ничего",), (None,), ("",)], "text string")
    m = pipeline.mask(df, "text", "token")
    rows = masking.restored(m.select("text", "masked", "placeholders"), "masked", "placeholders").collect()
    assert rows[0]["masked"] == "[EMAIL_1] пишет [EMAIL_2], снова [EMAIL_1]; тел. [PHONE_1]"
    assert [r["restored"] for r in rows] == [text, "ничего", None, ""]


def test_length_is_kept(spark):
    df = spark.createDataFrame([("Клиент Иванов Иван, карта 4111111111111111, почта я@почта.рф",)], "text string")
    for p in ("full", "full_ws", "partial"):
        r = pipeline.mask(df, "text", p).collect()[0]
        assert len(r["masked"]) == len(r["text"]) and r["masked"] != r["text"] and masking.keeps_length(p)


def test_looks_masked(spark):
    df = spark.createDataFrame([("*** ***", "full"), ("привет *", "full"), ("[FIO_1] [PHONE_2]", "token"), ("И. И.", "initials"), ("", "full"), (" ", "token")], "x string, p string")
    assert [r[0] for r in df.select(masking.looks_masked(F.col("x"), F.col("p"))).collect()] == [True, False, True, True, False, False]


def test_synthetic_values():
    for kind, value in (("CARD", "4111 1111 1111 1111"), ("INN", "500100732259"), ("SNILS", "112-233-445 95"), ("PHONE", "+7 916 123-45-67"), ("FIO", "Иванов Иван Иванович"), ("EMAIL", "a@b.ru"), ("DOB", "12.03.1985"), ("ADDRESS", "ул. Тихая, 5")):
        a = synthetic.synthetic_value(value, kind)
        assert a != value and a == synthetic.synthetic_value(value, kind)
        digits = "".join(c for c in a if c.isdigit())
        if kind == "CARD":
            assert v.luhn_valid(digits) and [len(x) for x in a.split()] == [4] * 4
        if kind == "INN":
            assert v.inn_valid(digits)
        if kind == "SNILS":
            assert v.snils_valid(digits)
    assert synthetic.replaced(None, None) is None and synthetic.replaced("", []) == ""


def test_conversation_counters(spark):
    turns = spark.createDataFrame([("c", 1, "Пишет a@b.ru"), ("c", 2, "Ответил c@d.ru, копия a@b.ru"), ("d", 1, "a@b.ru"), ("d", 2, None)], "conv string, turn int, text string")
    got = {(r["conv"], r["turn"]): r["masked"] for r in chat.masked_turns(turns, "conv", "turn", "text").collect()}
    assert got == {("c", 1): "Пишет [EMAIL_1]", ("c", 2): "Ответил [EMAIL_2], копия [EMAIL_1]", ("d", 1): "[EMAIL_1]", ("d", 2): None}
    answers = spark.createDataFrame([("c", "Пишите [EMAIL_2] и (email_1)"), ("c", "(EMAIL_1)"), ("x", "[EMAIL_1]")], "conv string, answer string")
    back = {r["answer"]: r["restored"] for r in chat.restored_answers(answers, chat.masked_turns(turns, "conv", "turn", "text"), "conv", "answer").collect()}
    assert back["(EMAIL_1)"] == "a@b.ru" and back["[EMAIL_1]"] == "[EMAIL_1]" and back["Пишите [EMAIL_2] и (email_1)"].startswith("Пишите c@d.ru")


def test_digit_runs(spark):
    texts = ["+7 916 123-45-67", "А123ВС", "1,2", "12\n34", "№5 / 6", "4509 № 123456", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = [[(r["value"], r["digits"], r["pattern"], r["plus"]) for r in (x["r"] or [])] for x in df.select(t.digit_runs(F.col("x")).alias("r")).collect()]
    assert got[0] == [("+7 916 123-45-67", "79161234567", "1-3-3-2-2", True)]
    assert got[1] == [("123", "123", "3", False)] and [x[0] for x in got[2]] == ["1", "2"] and [x[0] for x in got[3]] == ["12", "34"]
    assert [x[0] for x in got[4]] == ["5 / 6"] and got[5][0][2] == "4-6" and got[6] == []


def test_spelled_numbers(spark):
    df = spark.createDataFrame([("двадцать пять",), ("две тысячи три",), ("тысяча девятьсот сорок один",), ("нет",), (None,)], "x string")
    assert [r[0] for r in df.select(t.spelled_number(F.col("x"))).collect()] == [25, 2003, 1941, None, None]

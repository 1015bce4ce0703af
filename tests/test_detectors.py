"""Exact spans, in the manner of table tests: text, then type and value of each finding."""

import time

import pytest
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.operators import context, masking, numeric, patterns, pipeline, words
from spanveil.operators.scan import Look
from spanveil.schema import ALL_TYPES

CASES = [
    ("Паспорт 4509 123456 выдан ОВД", [("PASSPORT", "4509 123456"), ("ISSUER", "ОВД")]),
    ("паспорт серия 4509, номер 123456", [("PASSPORT", "4509, номер 123456")]),
    ("паспорт 4509 123456, к/п 770-001", [("PASSPORT", "4509 123456"), ("DEPT_CODE", "770-001")]),
    ("Иванов Иван Иванович обратился в банк", [("FIO", "Иванов Иван Иванович")]),
    ("плательщик иванов иван иванович", [("FIO", "иванов иван иванович")]),
    ("Клиент Иванов Иван Иванович, паспорт 4509 123456, тел. +7 916 123-45-67, ИНН 500100732259.", [("FIO", "Иванов Иван Иванович"), ("PASSPORT", "4509 123456"), ("PHONE", "+7 916 123-45-67"), ("INN", "500100732259")]),
    ("call +1 (152) 555-8590 now", [("PHONE", "+1 (152) 555-8590")]),
    ("4111111111111111", [("CARD", "4111111111111111")]),
    ("4111111111111111 4111111111111111", []),
    ("host 84.93.123.184", []),
    ("ip 84.93.123.184", [("IP_ADDRESS", "84.93.123.184")]),
    ("mail a.b@mail5.example.com.", [("EMAIL", "a.b@mail5.example.com")]),
    ("СНИЛС 112-233-445 95", [("SNILS", "112-233-445 95")]),
    ("карта 4276 1234 5678 9012, cvv 123", [("CARD", "4276 1234 5678 9012"), ("CVV", "123")]),
    ("госномер А123ВС 77", [("PLATE", "А123ВС 77")]),
    ("vin XTA21099043576182", [("VIN", "XTA21099043576182")]),
    ("в/у 77 АВ 123456", [("DRIVER_LICENSE", "77 АВ 123456")]),
    ("счёт 40817810099910004312", [("ACCOUNT", "40817810099910004312")]),
    ("место рождения: г. Саратов", [("BIRTH_PLACE", "г. Саратов")]),
    ("гражданство: Россия", [("CITIZENSHIP", "Россия")]),
    ("дата рождения 12.03.1985", [("DOB", "12.03.1985")]),
    ("дата рождения двенадцатое марта тысяча девятьсот восемьдесят пятого года", [("DOB", "двенадцатое марта тысяча девятьсот восемьдесят пятого")]),
    ("родился двадцать первого мая две тысячи третьего", [("DOB", "двадцать первого мая две тысячи третьего")]),
    ("Иван Петров, 1985 г.р.", [("FIO", "Иван Петров"), ("DOB", "1985")]),
    ("дата выдачи 29.02.2001", []),  # no such day
    ("г. Москва, ул. Ленина, д. 5, кв. 12", [("ADDRESS", "г. Москва, ул. Ленина, д. 5, кв. 12")]),
    ("индекс 101000", [("POSTCODE", "101000")]),
    ("пин-код 1234", [("PIN", "1234")]),
    ("звоните 8 800 555-35-35", []),  # toll-free
    ("заказ 4509 123456 отгружен", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, text string")
    rows = pipeline.settled(pipeline.detected(df, "text")).select("i", "text", "kept").collect()
    return {r["i"]: sorted((s["start"], s["type"], r["text"][s["start"] : s["end"]], s["conf"], s["reason"]) for s in r["kept"]) for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_exact_spans(found, i):
    got = found[i]
    assert sorted((x[1], x[2]) for x in got) == sorted(CASES[i][1])
    assert all(x[3] >= 0.6 and x[4] for x in got)


def test_no_text_raises(spark):
    texts = [" ", "0" * 300, "a" * 65_537, "😀" * 500, "\r\n\n\r", "@" * 50, "+" * 40, "№" * 30, "1" * 19 + "-" + "2" * 19, "ИП «" * 100, "İstanbul 12.12.2012", "[FIO_1] ***"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    rows = pipeline.mask(df, "text").select("text", "masked", "kept", "degraded").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert len(r["masked"]) == len(r["text"]) and not r["degraded"]
        assert all(0 <= s["start"] < s["end"] <= len(r["text"]) for s in r["kept"])


def test_custom_types(spark):
    rule = patterns.CustomType("loan", r"кд-[0-9]{4}", anchors=("договор",))
    df = spark.createDataFrame([("договор КД-1234, далее кд-9", 1), ("кд-0001", 2), (None, 3)], "text string, i int")
    got = {r["i"]: [(s["type"], s["start"], s["conf"]) for s in r["spans"]] for r in pipeline.detected(df, "text", ("EMAIL",), (rule,)).collect()}
    assert got == {1: [("LOAN", 8, 0.75)], 2: [("LOAN", 0, 0.6)], 3: []}
    for bad in (r"(?=x)y", r"(a)\1", r"a*"):
        with pytest.raises(ValueError):
            patterns.CustomType("x", bad).check()


def test_readers_are_pruned_and_registered(spark):
    """Readers of other types do not run, one more can be registered, and a failing one loses its own types only."""
    df = spark.createDataFrame([("a@b.ru, код ZX-9, тел. +7 916 123-45-67",)], "text string")
    plan = pipeline.mask(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    before = list(words.READERS)
    try:
        words.register("zx", ("ZX",), lambda look: [(look.text.find("ZX"), look.text.find("ZX") + 4, "ZX", 0.9, "zx:shape")])
        words.register("email", ("EMAIL",), lambda look: 1 / 0)
        row = pipeline.mask(df, "text", types=("PHONE", "ZX")).collect()[0]
        assert sorted(s["type"] for s in row["kept"]) == ["PHONE", "ZX"] and not row["degraded"]
        row = pipeline.mask(df, "text", types=("PHONE", "EMAIL")).collect()[0]
        assert [s["type"] for s in row["kept"]] == ["PHONE"] and row["degraded"]
    finally:
        words.READERS[:] = before


#: One hundred thousand repeats of what each pattern may loop over.
LONG = ["1 ", "1-", "a.", "a@", "@a.", "+7 ", "А1 ", "ул. ", "Иван ", "А. ", "[A", "<a ", "(1", ". ", "ё-", "01.01.", "01.01.1990 "]


def test_patterns_are_stack_safe_and_linear(spark):
    """Long repeats neither end the JVM nor take square time, in the column functions and in the readers."""
    df = spark.createDataFrame([(x * 100_000,) for x in LONG], "text string").repartition(4)
    x = F.col("text")
    sizes = df.select(F.size(t.digit_runs(x)).alias("runs"), F.size(patterns.email_spans(x)).alias("mail"), F.size(t.tokens(x)).alias("tokens"), F.size(t.sentences(x)).alias("sentences"), F.size(t.letter_words(x)).alias("words"), t.has_life_years(x).alias("years"))
    assert len(sizes.collect()) == len(LONG)
    for text in LONG:
        start = time.process_time()
        words.read(text * 20_000, frozenset(ALL_TYPES), 2026, "any")
        assert time.process_time() - start < 20, text


def test_places_of_many_matches(spark):
    """Places are summed up in blocks: they agree with a plain search for any number of matches."""
    import re

    texts = [" ".join(f"a{i}" for i in range(n)) for n in (0, 1, 63, 64, 65, 128, 1000)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", t.matches(F.col("text"), "[0-9]++").alias("m")).collect()
    for r in rows:
        assert [(m["start"], m["end"], m["value"]) for m in r["m"]] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", r["text"])]


def test_one_pass_agrees_with_the_steps(spark):
    """The one Arrow call and the column functions resolve and mask alike."""
    texts = [x for x, _ in CASES if x] + ["Иван Петров, Иван Петров и Анна Белова, тел. 8 916 123 45 67, 89161234567", "паспорт 4509 123456 4509 123456"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    steps = pipeline.settled(pipeline.detected(df, "text"))
    for preset in ("full", "full_ws", "partial", "initials", "token"):
        one = {r["i"]: r for r in pipeline.mask(df, "text", preset).collect()}
        for r in steps.withColumn("m", masking.masked(F.col("text"), F.col("kept"), F.lit(preset))).collect():
            got = one[r["i"]]
            assert (got["masked"], got["kept"], got["dropped"], got["placeholders"]) == (r["m"]["text"], r["kept"], r["dropped"], r["m"]["placeholders"])


def test_number_series(spark):
    """Numbers written in parts, glued to dates, and parts of longer numbers."""
    cases = {
        "Паспорт серия 27-12 номер 564508": [("PASSPORT", "27-12 номер 564508")], "Белова К.А. 1977-12-17 75 52 040112": [("PASSPORT", "75 52 040112")],
        "Григорьев 26-08-1990 7943 № 275956": [("PASSPORT", "7943"), ("PASSPORT", "275956")], "PIN-code: 07 и 26": [("PIN", "07")], "пин-код: 07: 26": [("PIN", "07"), ("PIN", "26")],
        "код подразделения 635.159. 938.772": [("DEPT_CODE", "635.159")], "телефн 916 123 45 67": [("PHONE", "916 123 45 67")], "г. Тверь, ул. Мира, 170100": [("POSTCODE", "170100")],
    }
    for text, wanted in cases.items():
        found = [(k, text[s:e]) for s, e, k, _, _ in numeric.numbers(Look(text))]
        assert found == wanted, text


def test_names_addresses_and_dates(spark):
    cases = {
        "Договор подписал Сергей Зайчик вчера": ("FIO", "Сергей Зайчик"), "Позвонила Анна Викторовна": ("FIO", "Анна Викторовна"), "Ответственный: Иванов А.П.": ("FIO", "Иванов А.П."), "Ivan Petrov called": ("FIO", "Ivan Petrov"),
        "Уважаемый Зубрик, ждём вас": ("FIO", "Зубрик"), "Вчера Татьяна пришла": ("FIO", "Татьяна"), "фамилия иванченко": ("FIO", "иванченко"), "Пришёл Кузнецов": ("FIO", "Кузнецов"),
        "живёт на ул. Садовая 12/3, кв. 7 (Тверская обл.)": ("ADDRESS", "ул. Садовая 12/3, кв. 7 (Тверская обл.)"), "адрес: Ленинский проспект, 15": ("ADDRESS", "Ленинский проспект, 15"), "дом 5 по ул. Победы, г. Орёл": ("ADDRESS", "дом 5 по ул. Победы, г. Орёл"),
        "lives at 12 Baker Street now": ("ADDRESS", "12 Baker Street"), "родился 5 янворя 1985 года": ("DOB", "5 янворя 1985 года"), "дата рождения 12031985": ("DOB", "12031985"), "born March 5, 1985": ("DOB", "March 5, 1985"),
    }
    for text, wanted in cases.items():
        found = [(x[2], text[x[0] : x[1]]) for x in words.read(text, frozenset(("FIO", "ADDRESS", "DOB")), 2026, "pii_context")]
        assert wanted in found, (text, found)


def test_context_exclusions(spark):
    rows = [
        (0, "Офис банка: г. Москва, ул. Ленина, д. 5", "ADDRESS", "org_address"), (1, "Проживает: г. Москва, ул. Ленина, д. 5", "ADDRESS", None), (2, "Писатель Лев Громов родился давно", "FIO", "public_figure"),
        (3, "Клиент Лев Громов, паспорт 4509 123456", "FIO", None), (4, "заявка 8 916 123 45 67", "PHONE", "reference_number"), (5, "телефон 8 916 123 45 67", "PHONE", None), (6, "Иван Иванов", "FIO", "allow_list"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "i int, text string")
    s = pipeline.detected(df, "text").withColumn("low", t.lower_same_width(F.col("text")))
    s = s.withColumn("j", context.excluded(F.col("text"), F.col("low"), F.col("spans"), context.Exclusions(allowed=("иван  ИВАНОВ",))))
    got = {r["i"]: {x["type"]: x["why"] for x in r["j"]} for r in s.collect()}
    for i, _, kind, why in rows:
        assert got[i][kind] == why, i

"""NULLs in any column, empty and very long texts, repeated rows, empty tables, extra columns with clashing names: every
operator gives its defined result."""

import pytest
from pyspark.sql import functions as F

from spanveil.llm import encode, format_copies, leaks, lookalike, pii, quota, structure, stuffing

LONG = "Слово за словом идёт длинный текст, в котором ничего нет. " * 6000
CLASHING = "n_rows string, raw_key string, page string, k string, t string, row_id string, chance string, n string, w string, size string, form string, look_key string, first_id string, kept string"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "a", None), (2, None, ""), (3, "b", "Пишите на a@b.ru, тел. +7 916 123-45-67"), (3, "b", "Пишите на a@b.ru, тел. +7 916 123-45-67"), (4, "c", LONG), (None, "d", "x"), (5, None, " \n\t"), (6, "", "​"), (7, "e", "😀" * 300), (8, "f", "\x00\x01")]
    n = CLASHING.count(",") + 1
    return spark.createDataFrame([(*r, *["clash"] * n) for r in rows], f"id int, key string, text string, {CLASHING}")


def test_no_operator_fails(texts):
    items = texts.sparkSession.createDataFrame([(1, None), (2, ""), (3, "a"), (4, LONG[:900])], "item int, body string")
    runs = {
        "copies": format_copies.copies(texts, "id", "key", "text"), "records": format_copies.records_with_copies(texts, "id", "key", "text"), "statistics": structure.text_statistics(texts, "id", "text"),
        "pairs": lookalike.look_alike_pairs(texts, "id", "text"), "forms": lookalike.consistent_texts(texts, "text"), "kinds": pii.found_kinds(texts, "id", "text"), "redacted": pii.redacted(texts, "id", "text"),
        "ids": encode.encode_column(texts, "id", "text"), "leaks": leaks.leaked(texts, "id", "text", items, "item", "body"), "pages": stuffing.stuffed_pages(texts, "id", "text"),
    }
    sizes = {k: len(df.collect()) for k, df in runs.items()}
    assert sizes["records"] == 9 and sizes["statistics"] == sizes["forms"] == sizes["redacted"] == sizes["ids"] == 10
    assert sizes["copies"] == 0 and sizes["leaks"] == 1 and sizes["pages"] == 0  # a repeated id is no copy of itself


def test_empty_tables(texts):
    none = texts.limit(0)
    items = none.sparkSession.createDataFrame([], "item int, body string")
    for df in (
        format_copies.copies(none, "id", "key", "text"), format_copies.records_with_copies(none, "id", "key", "text"), structure.not_prose(none, "id", "text"), lookalike.look_alike_pairs(none, "id", "text"),
        lookalike.known_value_matches(none, texts, "id", "id", "text"), lookalike.known_value_matches(texts, none, "id", "id", "text"), pii.found_kinds(none, "id", "text"), encode.encode_column(none, "id", "text"),
        leaks.leaked(none, "id", "text", texts, "id", "text"), leaks.leaked(texts, "id", "text", items, "item", "body"), stuffing.stuffed_pages(none, "id", "text"),
    ):
        assert df.collect() == []
    sample, report = quota.sample_by_target(none, "id", "key", [("a", 500, 1, 100)])
    assert sample.collect() == [] and [tuple(r)[:4] for r in report.collect()] == [("a", 0, 1, 0)]


def test_defined_values(texts):
    ids = {(r["id"], len(r["ids"])) for r in encode.encode_column(texts, "id", "text").where("id in (1, 2)").collect()}
    assert ids == {(1, 0), (2, 0)}
    s = {r["row_id"]: r["structure"] for r in structure.text_statistics(texts, "id", "text").where("row_id in (1, 2)").collect()}
    assert s == {1: None, 2: None}
    r = {x["row_id"]: x["redacted"] for x in pii.redacted(texts, "id", "text").collect()}
    assert r[1] is None and r[2] == "" and r[3] == "Пишите на [EMAIL], тел. [PHONE]" and r[4] == LONG
    f = {x["id"]: x["form"] for x in lookalike.consistent_texts(texts, "text").select("id", "form").collect()}
    assert f[1] is None and f[2] == "" and f[6] == "" and f[4] == LONG


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "id int, key string, text string")
    assert format_copies.copies(df, "id", "key", "text").count() == 0 and pii.found_kinds(df, "id", "text").count() == 0
    assert format_copies.records_with_copies(df, "id", "key", "text").agg(F.sum("n_copies")).collect()[0][0] == 2
    _, report = quota.sample_by_target(df, "id", "key", [(quota.MISSING, 1000, 1, 1000)])
    assert [tuple(r)[:4] for r in report.collect()] == [(quota.MISSING, 2, 2, 2)]

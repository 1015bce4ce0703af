"""Text primitives and validators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions import validators as v
from spanveil.operators import corpus, quality
from spanveil.plans.registry import query
from spanveil.runtime import spread, table

_ANCHORS = ("паспорт", "номер", "заявка", "заявки", "договор", "срок ответа", "request", "account statement", "карта")
_SEP = r" \t\x{a0}\x{202f}\-\x{2013}\x{2014}\x{2011}./()\\№#"


@query(
    r"""SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g'))::INT AS digits, length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g'))::INT AS cyrillic,
    length(regexp_replace(text, '[^\p{Latin}]', '', 'g'))::INT AS latin, length(regexp_replace(text, '[^ \t\n\r]', '', 'g'))::INT AS blanks FROM documents"""
)
def t_char_classes(spark, d):
    n = lambda p: F.length(F.regexp_replace("text", p, ""))
    return table(spark, d, "documents").select("doc_id", n("[^0-9]").alias("digits"), n(r"[^\p{IsCyrillic}]").alias("cyrillic"), n(r"[^\p{IsLatin}]").alias("latin"), n(r"[^ \t\n\r]").alias("blanks"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+|\p{Cyrillic}+|\p{Latin}+'))::INT AS n_words FROM documents""")
def t_tokens(spark, d):
    kept = F.filter(t.tokens(F.col("text")), lambda x: t.char_class(x).isin("digit", "cyrillic", "latin"))
    return spread(table(spark, d, "documents")).select("doc_id", F.size(kept).alias("n_words")).withColumn("n_words", F.when(F.col("n_words") >= 0, F.col("n_words")))


@query(
    rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[\p{{Latin}}\p{{Cyrillic}}][0-9]+|\+?[0-9]+(?:[{_SEP}]{{1,3}}[0-9]+)*') AS vals,
      string_split_regex(text, '[\p{{Latin}}\p{{Cyrillic}}][0-9]+|\+?[0-9]+(?:[{_SEP}]{{1,3}}[0-9]+)*') AS gaps FROM documents),
    e AS (SELECT doc_id, unnest(generate_series(1, len(vals))) AS i, vals, gaps FROM m),
    p AS (SELECT doc_id, i, vals[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(vals[1:i - 1], lambda x: length(x))), 0) AS s FROM e),
    q AS (SELECT doc_id, i, s, v, CASE WHEN regexp_matches(v, '^[\p{{Latin}}\p{{Cyrillic}}]') THEN 1 ELSE 0 END AS lead FROM p)
    SELECT doc_id, (s + lead)::INT AS start_char, (s + length(v))::INT AS end_char, regexp_replace(v[lead + 1:], '[^0-9]', '', 'g') AS digits,
      array_to_string(list_transform(regexp_extract_all(v, '[0-9]+'), lambda g: length(g)::VARCHAR), '-') AS pattern, (v[1] = '+') AS plus FROM q"""
)
def t_digit_runs(spark, d):
    runs = spread(table(spark, d, "documents")).select("doc_id", F.explode(t.digit_runs(F.col("text"))).alias("r"))
    return runs.select("doc_id", F.col("r.start").alias("start_char"), F.col("r.end").alias("end_char"), "r.digits", "r.pattern", "r.plus")


@query(
    r"""SELECT fragment_id, trim(value, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || '.,;:!?"''«»()[]{}<>№#-–—/\') AS trimmed,
    regexp_replace(translate(lower(trim(value)), 'ё', 'е'), '[ \t\n\x0b\f\r]+', ' ', 'g') AS plain, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
    translate(value, 'aeopcyxAEOPCYX', 'аеорсухАЕОРСУХ') AS folded FROM fragments"""
)
def t_value_forms(spark, d):
    x = F.col("value")
    return spread(table(spark, d, "fragments")).select("fragment_id", t.trimmed(x).alias("trimmed"), t.plain(x).alias("plain"), t.digits_only(x).alias("digits"), t.fold_alike(x).alias("folded"))


@query(
    """SELECT doc_id, strlen(text) / 2.8::DOUBLE AS tokens, (0.57::DOUBLE + 1.56::DOUBLE * strlen(text) / 1024) * CASE WHEN strlen(text) > 2048 THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END AS core_ms,
    sha256(text) AS digest FROM documents"""
)
def t_costs(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.estimated_tokens(x).alias("tokens"), t.core_millis(F.octet_length(x)).alias("core_ms"), F.sha2(x, 256).alias("digest"))


@query(
    r"""SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, len(list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda p: trim(p) <> ''))::INT AS n_paragraphs,
    len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?;])([ \t\n\x0b\f\r])', '\1' || chr(1) || '\2', 'g'), '\x01|\n'), lambda s: regexp_replace(s, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')), lambda s: s <> ''))::INT AS n_sentences FROM documents WHERE text IS NOT NULL"""
)
def t_structure(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t.lines(x)).alias("n_lines"), F.size(t.paragraphs(x)).alias("n_paragraphs"), F.size(t.sentences(x)).alias("n_sentences"))


@query(
    rf"""WITH w AS (SELECT DISTINCT translate(lower(unnest(regexp_extract_all(text, '[\p{{Cyrillic}}\p{{Latin}}]+'))), 'ё', 'е') AS word FROM eval_items)
    SELECT word, regexp_replace(word, '^(.{{3,40}}?)(?:{"|".join(t.STEM_ENDINGS)})$', '\1') AS stem FROM w"""
)
def t_stems(spark, d):
    words = table(spark, d, "eval_items").select(F.explode(t.letter_words(F.col("text"))).alias("word")).select(F.translate(F.lower("word"), "ё", "е").alias("word")).distinct()
    return words.select("word", t.stem(F.col("word")).alias("stem"))


@query(
    """WITH a AS (SELECT doc_id, text, instr(text, '@') AS p FROM documents WHERE instr(text, '@') > 0)
    SELECT doc_id, strlen(substring(text, 1, p - 1))::INT AS at_byte, substring(text, greatest(p - 20, 1), (p + 10) - greatest(p - 20, 1)) AS around FROM a"""
)
def t_windows(spark, d):
    df = table(spark, d, "documents").where(F.instr("text", "@") > 0).withColumn("at", F.instr("text", "@") - 1)
    return df.select("doc_id", t.byte_offset(F.col("text"), F.col("at")).alias("at_byte"), t.cut(F.col("text"), F.col("at") - 20, F.col("at") + 10).alias("around"))


@query(
    f"""SELECT doc_id, list_filter({sorted(_ANCHORS, key=lambda a: (-len(a), a))}, lambda a: contains(lower(text), a))[1] AS anchor,
    regexp_matches(text, '\\(\\s*[12][0-9]{{3}}[^0-9]{{1,8}}[12][0-9]{{3}}\\s*\\)') AS life_years FROM documents"""
)
def t_anchors(spark, d):
    return table(spark, d, "documents").select("doc_id", t.longest_anchor(F.lower("text"), _ANCHORS).alias("anchor"), t.has_life_years(F.col("text")).alias("life_years"))


@query("SELECT doc_id, substring(repeat(text, ceil(3000 / greatest(length(text), 1))::INT), 1, 3000) AS inflated FROM documents WHERE length(text) >= 1")
def t_inflated(spark, d):
    return table(spark, d, "documents").where(F.length("text") >= 1).select("doc_id", t.inflated(F.col("text"), F.lit(3000)).alias("inflated"))


_D = "regexp_replace(value, '[^0-9]', '', 'g')"


def _sum(weights, at="d"):
    return " + ".join(f"coalesce(try_cast({at}[{i + 1}] AS INT), 0) * {w}" for i, w in enumerate(weights))


@query(
    rf"""WITH f AS (SELECT fragment_id, value, {_D} AS d FROM fragments)
    SELECT fragment_id,
      CASE WHEN length(d) BETWEEN 12 AND 19 THEN list_sum(list_transform(generate_series(1, length(d)), lambda i:
        CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT * 2 > 9 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0 ELSE false END AS luhn,
      CASE WHEN length(d) = 10 THEN ({_sum(v.INN10)}) % 11 % 10 = d[10]::INT WHEN length(d) = 12 THEN ({_sum(v.INN12A)}) % 11 % 10 = d[11]::INT AND ({_sum(v.INN12B)}) % 11 % 10 = d[12]::INT ELSE false END AS inn,
      CASE WHEN length(d) = 11 THEN ({_sum(range(9, 0, -1))}) % 101 % 100 = d[10:11]::INT ELSE false END AS snils,
      regexp_matches(d, '^[78]80[034][0-9]{{7}}$') AS toll_free,
      regexp_matches(value, '^(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])){{3}}$') AS ipv4,
      regexp_matches(value, '^\[[\p{{Lu}}_]+_[0-9]+\]$') AS placeholder, regexp_matches(value, '^[0-9A-HJ-NPR-Za-hj-npr-z]{{17}}$') AND regexp_matches(value, '[0-9]') AS vin,
      regexp_matches(value, '^[A-Za-z0-9._:\-]{{1,64}}$') AND NOT regexp_matches(value, '^[0-9]{{6,}}$') AS plausible_id FROM f"""
)
def v_checks(spark, d):
    x, n = F.col("value"), t.digits_only(F.col("value"))
    return spread(table(spark, d, "fragments")).select(
        "fragment_id", v.luhn(n).alias("luhn"), v.inn(n).alias("inn"), v.snils(n).alias("snils"), v.toll_free(n).alias("toll_free"), v.ipv4(x).alias("ipv4"),
        v.placeholder(x).alias("placeholder"), v.vin(x).alias("vin"), v.plausible_id(x).alias("plausible_id"),
    )


@query(
    r"""SELECT fragment_id, coalesce(try_strptime(value, '%d.%m.%Y') IS NOT NULL, false) AS valid,
    CASE WHEN try_cast(regexp_extract(value, '([0-9]{4})$', 1) AS INT) BETWEEN 1900 AND 2026 THEN try_cast(regexp_extract(value, '([0-9]{4})$', 1) AS INT) END AS year
    FROM fragments WHERE regexp_matches(value, '^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$')"""
)
def v_dates(spark, d):
    part = lambda i: F.regexp_extract("value", r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$", i)
    df = table(spark, d, "fragments").where(F.col("value").rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"))
    return df.select("fragment_id", v.calendar_date(part(3), part(2), part(1)).alias("valid"), v.full_year(part(3), 2026).alias("year"))


@query(
    """SELECT coalesce(fault, 'sound') AS fault, count(*) AS n FROM (SELECT CASE WHEN coalesce(text, '') = '' THEN 'empty_text'
      WHEN coalesce(source, '') NOT IN ('synthetic', 'wikipedia', 'hf_ru_pii', 'reviews', 'ai4privacy') THEN 'unknown_source'
      WHEN len(list_filter(spans, lambda s: s.start_byte < 0 OR s.end_byte <= s.start_byte OR s.end_byte > strlen(text))) > 0 THEN 'bounds' END AS fault FROM samples) GROUP BY 1"""
)
def v_record_faults(spark, d):
    fault = corpus.record_fault(F.col("sample_id"), F.col("text"), F.col("source"), F.col("spans"))
    return table(spark, d, "samples").select(F.coalesce(fault, F.lit("sound")).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT sample_id, text, unnest(spans) AS s FROM samples WHERE text <> ''),
    p AS (SELECT sample_id, text, s.type AS type, s.start_byte AS a, s.end_byte AS b, list_transform(generate_series(1, length(text)), lambda i: strlen(substring(text, 1, i - 1))) AS starts FROM s)
    SELECT sample_id, type, a AS start_byte, (list_position(starts, a) - 1)::INT AS start_char, coalesce(list_position(starts, b) - 1, length(text))::INT AS end_char,
      substring(text, list_position(starts, a), coalesce(list_position(starts, b), length(text) + 1) - list_position(starts, a)) AS value FROM p"""
)
def v_span_slices(spark, d):
    s = spread(table(spark, d, "samples")).where("text <> ''").select("sample_id", "text", F.explode("spans").alias("s"))
    c = quality.char_span(F.col("text"), F.col("s.start_byte"), F.col("s.end_byte"))
    s = s.withColumn("c", c)
    return s.select("sample_id", "s.type", "s.start_byte", F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"), t.cut(F.col("text"), F.col("c.start"), F.col("c.end")).alias("value"))

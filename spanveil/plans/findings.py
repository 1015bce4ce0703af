"""Detectors over whole tables: findings, masks, subjects, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions import validators as v
from spanveil.operators import chat, context, masking, patterns, pipeline, policy, spans, subjects, words
from spanveil.plans import number_sql
from spanveil.plans.registry import query
from spanveil.runtime import spread, table

_SEP = r" \t\x{a0}\x{202f}\-\x{2013}\x{2014}\x{2011}./()\\№#"
_RUN = rf"[\p{{Latin}}\p{{Cyrillic}}][0-9]+|\+?[0-9]+(?:[{_SEP}]{{1,3}}[0-9]+)*"
_EMAIL = r"[\p{L}\p{Nd}!#$%&''*+/=?^_`{|}~][\p{L}\p{Nd}.!#$%&''*+/=?^_`{|}~-]*@[\p{L}\p{Nd}-]+(?:\.[\p{L}\p{Nd}-]+)*\.\p{L}{2,}"


@query()
def masked_documents_by_type(spark, d):
    """The flagship: findings of all types in the documents, resolved and masked, counted by source and type."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    out = pipeline.mask(docs, "text", "full")
    found = out.select("source", F.length("masked").alias("n"), F.explode("kept").alias("s"))
    return found.groupBy("source", "s.type").agg(F.count("*").alias("findings"), F.sum(F.col("s.end") - F.col("s.start")).alias("masked_chars"))


@query(
    rf"""WITH m AS (SELECT source, regexp_extract_all(text, '{_EMAIL}') AS mail, regexp_extract_all(text, '{_RUN}') AS runs FROM documents),
    r AS (SELECT source, regexp_replace(v, '^[\p{{Latin}}\p{{Cyrillic}}]', '') AS v FROM (SELECT source, unnest(runs) AS v FROM m)),
    n AS (SELECT source, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM r),
    f AS (SELECT source, 'EMAIL' AS type, length(v) AS n FROM (SELECT source, unnest(mail) AS v FROM m)
      UNION ALL SELECT source, 'CARD', length(v) FROM n WHERE length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(1, length(d)), lambda i:
        CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT * 2 > 9 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0
      UNION ALL SELECT source, 'PHONE', length(v) FROM n WHERE v[1] = '+' AND length(d) BETWEEN 10 AND 15)
    SELECT source, type, count(*) AS findings, sum(n)::BIGINT AS chars FROM f GROUP BY ALL"""
)
def d_shapes(spark, d):
    """E-mails, numbers with a card's control digit and international phones, by shape alone."""
    docs = spread(table(spark, d, "documents")).select("source", "text")
    card = lambda r: F.length(r["digits"]).between(13, 19) & v.luhn(r["digits"])
    phone = lambda r: r["plus"] & F.length(r["digits"]).between(10, 15)
    named = lambda runs, kind, keep: F.transform(F.filter(runs, keep), lambda r: F.struct(F.lit(kind).alias("type"), F.length(r["value"]).alias("n")))
    numbers = t.let(t.digit_runs(F.col("text")), lambda runs: F.concat(named(runs, "CARD", card), named(runs, "PHONE", phone)))
    mail = F.transform(patterns.email_spans(F.col("text")), lambda s: F.struct(s["type"].alias("type"), (s["end"] - s["start"]).alias("n")))
    return docs.select("source", F.explode(F.concat(mail, numbers)).alias("x")).groupBy("source", "x.type").agg(F.count("*").alias("findings"), F.sum("x.n").alias("chars"))


@query(
    rf"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS vals, string_split_regex(text, '{_EMAIL}') AS gaps FROM documents),
    e AS (SELECT doc_id, text, unnest(generate_series(1, len(vals))) AS i, vals, gaps FROM m),
    p AS (SELECT doc_id, text, vals[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(vals[1:i - 1], lambda x: length(x))), 0) AS s FROM e)
    SELECT doc_id, s::INT AS start_char, (s + length(v))::INT AS end_char, strlen(substring(text, 1, s::INT))::INT AS start_byte, v AS value FROM p"""
)
def d_emails(spark, d):
    docs = spread(table(spark, d, "documents")).where(F.col("text").contains("@"))
    s = docs.select("doc_id", "text", F.explode(patterns.email_spans(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), t.byte_offset(F.col("text"), F.col("s.start")).alias("start_byte"), t.cut(F.col("text"), F.col("s.start"), F.col("s.end")).alias("value"))


def _findings(df, key):
    return df.select(key, F.explode("spans").alias("s")).select(key, "s.*")


@query(number_sql.number_sql("samples", "sample_id", "text"))
def d_numbers(spark, d):
    """What each number of a sample is by itself: phones, cards, pension and tax numbers, licences, passports, codes."""
    s = spread(table(spark, d, "samples").select("sample_id", "text"))
    return _findings(s.withColumn("spans", words.number_singles(F.col("text"))), "sample_id")


@query()
def d_number_series(spark, d):
    """Numbers written in parts: passports with words between series and number or glued to a date, codes in pairs."""
    out = pipeline.detected(table(spark, d, "samples").select("sample_id", "text"), "text", ("PASSPORT", "PIN"))
    return _findings(out, "sample_id").where(F.col("reason").isin("passport:series_number_words", "passport:after_date", "pin:split_pair"))


@query(number_sql.document_sql("samples", "sample_id", "text"))
def d_document_numbers(spark, d):
    """Accounts, insurance numbers and documents told by a number and an anchor before it."""
    out = pipeline.detected(table(spark, d, "samples").select("sample_id", "text"), "text", ("ACCOUNT", "OMS", "SNILS", "FOREIGN_PASSPORT", "RESIDENCE_PERMIT"))
    reasons = ("account:anchor", "oms:anchor", "oms:anchor_luhn", "snils:extra_anchor", "foreign_passport:anchor", "residence_permit:anchor")
    return _findings(out, "sample_id").where(F.col("reason").isin(*reasons))


@query()
def d_document_shapes(spark, d):
    """Plates, vehicles, network addresses, licences with letters, birth certificates and military cards among the values."""
    f = table(spark, d, "fragments").select("fragment_id", F.concat_ws(": ", F.lower("type"), "value").alias("text"))
    out = pipeline.detected(f, "text", ("PLATE", "VIN", "IP_ADDRESS", "DRIVER_LICENSE", "BIRTH_CERT", "MILITARY_ID"))
    return _findings(out, "fragment_id").where(~F.col("reason").startswith("driver:"))


@query()
def d_words(spark, d):
    """Names, dates, addresses, places of birth, issuers, citizenship and card holders."""
    out = pipeline.detected(table(spark, d, "samples").select("sample_id", "text"), "text", pipeline.WORDS)
    return out.select("sample_id", F.explode("spans").alias("s")).select("sample_id", "s.*")


REQUEST_NUMBER = patterns.CustomType("request_no", r"[тзк]-[0-9]{4,6}", anchors=("заявка", "заявки"))


@query(
    r"""WITH m AS (SELECT sample_id, unnest(regexp_extract_all(lower(text), '[тзк]-[0-9]{4,6}')) AS value FROM samples)
    SELECT sample_id, value, count(*) AS n FROM m GROUP BY ALL"""
)
def d_custom(spark, d):
    """A type of the user's own: request numbers."""
    s = spread(table(spark, d, "samples")).where("text is not null").select("sample_id", F.lower("text").alias("low"))
    s = s.select("sample_id", "low", F.explode(patterns.custom_spans(F.col("low"), REQUEST_NUMBER)).alias("s"))
    return s.select("sample_id", t.cut(F.col("low"), F.col("s.start"), F.col("s.end")).alias("value")).groupBy("sample_id", "value").agg(F.count("*").alias("n"))


@query()
def p_explained(spark, d):
    """Every finding of the raw payloads, kept or dropped, with bytes, value, confidence and reason."""
    return pipeline.explain(table(spark, d, "raw_samples"), "raw_id", "payload")


@query()
def p_masked_by_policy(spark, d):
    """Samples masked under the policy of their system: types, confidence, date mode and preset."""
    s = policy.joined(table(spark, d, "samples").select("sample_id", "system_id", "text"), table(spark, d, "systems"))
    out = pipeline.mask(s, "text", F.col("preset"), min_conf=F.col("min_conf"), allowed=F.col("types"), date_mode=F.col("date_mode"))
    return out.select("sample_id", "system_id", "preset", "masked", F.size("kept").alias("n_kept"), F.size("dropped").alias("n_dropped"))


@query()
def p_synthetic(spark, d):
    """Samples with made-up values in place of the found ones."""
    return pipeline.mask(table(spark, d, "samples").select("sample_id", "text"), "text", "synthetic").select("sample_id", "masked", spans.counts_by_type(F.col("kept")).alias("counts"))


@query("SELECT sample_id, CASE WHEN text IS NOT NULL THEN true END AS same FROM samples")
def p_restored(spark, d):
    """Samples masked by placeholders and restored; `same` says whether the round trip is exact."""
    out = pipeline.mask(table(spark, d, "samples").select("sample_id", "text"), "text", "token").select("sample_id", "text", "masked", "placeholders")
    return masking.restored(out, "masked", "placeholders").select("sample_id", (F.col("restored") == F.col("text")).alias("same"))


@query()
def x_excluded(spark, d):
    """Findings that the context excludes, by reason."""
    s = pipeline.detected(table(spark, d, "samples").where("text is not null").select("sample_id", "text"), "text")
    s = s.withColumn("low", t.lower_same_width(F.col("text")))
    rules = context.Exclusions(allowed=("192.0.2.10",), figures=("пушкин александр", "гагарин юрий"))
    judged = s.select("sample_id", F.explode(context.excluded(F.col("text"), F.col("low"), F.col("spans"), rules)).alias("s"))
    return judged.groupBy("s.type", "s.why").agg(F.count("*").alias("n"))


@query()
def g_subjects(spark, d):
    """Which findings of a sample belong together, with the types of each subject."""
    s = pipeline.mask(table(spark, d, "samples").where("text is not null").select("sample_id", "text"), "text").select("sample_id", "text", "kept")
    s = s.withColumn("links", subjects.links(F.col("text"), F.col("kept")))
    x = s.select("sample_id", F.posexplode(F.arrays_zip("kept", "links")).alias("pos", "x"))
    return x.groupBy("sample_id", F.col("x.links.subject").alias("subject")).agg(F.count("*").alias("n_spans"), F.array_sort(F.collect_set("x.kept.type")).alias("types"))


@query()
def g_edges(spark, d):
    s = pipeline.mask(table(spark, d, "samples").where("text is not null").select("sample_id", "text"), "text").select("sample_id", "text", "kept")
    s = s.withColumn("edges", subjects.edges(F.col("text"), F.col("kept")))
    return s.select("sample_id", F.explode("edges").alias("e")).select("sample_id", "e.*")


@query()
def c_masked_turns(spark, d):
    """Samples of one payload as the turns of a conversation, with placeholders numbered through it."""
    turns = table(spark, d, "samples").where("text is not null").select("payload_id", "sample_id", "text")
    return chat.masked_turns(turns, "payload_id", "sample_id", "text").select("payload_id", "sample_id", "masked", F.size("placeholders").alias("n_placeholders"))

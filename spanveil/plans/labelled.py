"""Operators over labelled spans and plain columns, each with a SQL twin: masking and numbering of given spans, links between
them, marks of their context, what masking changes outside them, gates, merged mappings, written and read back data."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions import validators as v
from spanveil.operators import chat, context, masking, metrics, pipeline, policy, quality, subjects
from spanveil.plans.registry import query
from spanveil.runtime import scratch_path, table
from spanveil.schema import SPANS
from spanveil.sources import readers, writers

#: One row for each labelled span, in characters: a, b, value, and its place i in the row's array.
_SPANS = """s AS (SELECT sample_id, text, unnest(spans) AS s, generate_subscripts(spans, 1) - 1 AS i FROM samples WHERE text <> '' AND NOT partial_labels),
  q AS (SELECT sample_id, text, i, s.type AS type, s.start_byte AS ab, s.end_byte AS bb, list_transform(generate_series(1, length(text)), lambda k: strlen(substring(text, 1, k - 1))) AS starts FROM s),
  c AS (SELECT sample_id, text, i, type, (list_position(starts, ab) - 1)::INT AS a, coalesce(list_position(starts, bb) - 1, length(text))::INT AS b FROM q),
  v AS (SELECT *, substring(text, a + 1, b - a) AS value FROM c)"""
_INITIALS = r"""CASE WHEN len(regexp_extract_all(value, '\p{L}[\p{L}-]*')) = 0 THEN repeat('*', length(value))
  ELSE array_to_string(list_transform(regexp_extract_all(value, '\p{L}[\p{L}-]*'), lambda w: upper(substring(w, 1, 1)) || '.'), ' ') END"""


def _labelled(spark, d):
    """Samples with complete labels; spans in characters, by place."""
    s = table(spark, d, "samples").where("text <> '' and not partial_labels").select("sample_id", "text", "spans")

    def span(x):
        c = quality.char_span(F.col("text"), x["start_byte"], x["end_byte"])
        return t.let(c, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), x["type"].alias("type"), F.lit(1.0).alias("conf"), F.lit("label").alias("reason")))

    return s.withColumn("spans", F.transform("spans", span).cast(SPANS))


@query(
    rf"""WITH {_SPANS}, o AS (SELECT *, lag(b, 1, 0) OVER w AS before, repeat('*', b - a) AS stars, {_INITIALS} AS short FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY a, b))
    SELECT sample_id, string_agg(substring(text, before + 1, a - before) || stars, '' ORDER BY a) || substring(any_value(text), max(b) + 1) AS full_text,
      string_agg(substring(text, before + 1, a - before) || short, '' ORDER BY a) || substring(any_value(text), max(b) + 1) AS initials_text FROM o GROUP BY sample_id"""
)
def m_spliced(spark, d):
    """Labelled spans replaced in their texts, by two presets."""
    s = _labelled(spark, d).where(F.size("spans") > 0)
    by = F.array_sort("spans", lambda a, b: a["start"] - b["start"])
    put = lambda p: masking.masked(F.col("text"), by, F.lit(p))["text"]
    return s.select("sample_id", put("full").alias("full_text"), put("initials").alias("initials_text"))


@query(
    f"""WITH {_SPANS}, f AS (SELECT *, min(a) OVER (PARTITION BY sample_id, type, value) AS first_at FROM v),
    n AS (SELECT *, '[' || type || '_' || dense_rank() OVER (PARTITION BY sample_id, type ORDER BY first_at) || ']' AS token, lag(b, 1, 0) OVER (PARTITION BY sample_id ORDER BY a, b) AS before FROM f)
    SELECT sample_id, string_agg(substring(text, before + 1, a - before) || token, '' ORDER BY a) || substring(any_value(text), max(b) + 1) AS masked, count(*)::INT AS n_placeholders FROM n GROUP BY sample_id"""
)
def m_numbered(spark, d):
    """Labelled spans replaced by placeholders, numbered by first appearance of each value of a type."""
    s = _labelled(spark, d).where(F.size("spans") > 0)
    m = masking.masked(F.col("text"), F.array_sort("spans", lambda a, b: a["start"] - b["start"]), F.lit("token"))
    return s.select("sample_id", m.alias("m")).select("sample_id", F.col("m.text").alias("masked"), F.size("m.placeholders").alias("n_placeholders"))


_FORM = "^(?:" + "|".join(x.replace(".", "\\.") for x in subjects.FORM_ANCHORS) + "):"
#: Sentence, questionnaire (by the line before its first, NULL outside one) and compared value of each span.
_GROUPS = rf"""k AS (SELECT sample_id, i, len(regexp_extract_all(substring(text, 1, a), '\n')) + len(regexp_extract_all(substring(text, 1, a + 1), '[.!?;][ \n]')) AS sentence,
  trim(regexp_replace(lower(value), '\s+', ' ', 'g')) AS plain, len(regexp_extract_all(substring(text, 1, a), '\n')) AS line,
  list_transform(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '{_FORM}')) AS hits FROM v),
  h AS (SELECT *, CASE WHEN hits[line + 1] THEN coalesce(list_max(list_filter(generate_series(1, line + 1), lambda j: NOT hits[j])), 0) END AS block FROM k)"""


@query(
    f"""WITH {_SPANS}, {_GROUPS}, g AS (SELECT sample_id, i, 'sentence' AS basis, 0.6::DOUBLE AS conf, min(i) OVER (PARTITION BY sample_id, sentence) AS a FROM h
      UNION ALL SELECT sample_id, i, 'repeat', 0.9::DOUBLE, min(i) OVER (PARTITION BY sample_id, plain) FROM h
      UNION ALL SELECT sample_id, i, 'anchor', 0.9::DOUBLE, min(i) OVER (PARTITION BY sample_id, block) FROM h WHERE block IS NOT NULL)
    SELECT sample_id, a::INT AS a, i::INT AS b, basis, conf FROM g WHERE a < i"""
)
def g_star_edges(spark, d):
    """Labelled spans linked with the first span of their sentence, their questionnaire and their value: linear in spans."""
    s = _labelled(spark, d).withColumn("edges", subjects.edges(F.col("text"), F.col("spans")))
    return s.select("sample_id", F.explode("edges").alias("e")).select("sample_id", "e.a", "e.b", "e.basis", "e.conf")


@query(
    f"""WITH RECURSIVE {_SPANS}, {_GROUPS}, e AS (SELECT x.sample_id, x.i, y.i AS j FROM h x JOIN h y ON x.sample_id = y.sample_id AND (x.sentence = y.sentence OR x.plain = y.plain OR x.block = y.block)),
    r AS (SELECT sample_id, i, j FROM e UNION SELECT r.sample_id, r.i, e.j FROM r JOIN e ON e.sample_id = r.sample_id AND e.i = r.j)
    SELECT sample_id, i::INT AS pos, min(j)::INT AS subject FROM r GROUP BY ALL"""
)
def g_components(spark, d):
    """The subject of each labelled span: the connected components of the links, named by their first span."""
    s = _labelled(spark, d).withColumn("links", subjects.links(F.col("text"), F.col("spans")))
    return s.select("sample_id", F.posexplode("links").alias("pos", "x")).select("sample_id", "pos", "x.subject")


@query(
    rf"""WITH {_SPANS} SELECT sample_id, i::INT AS pos, regexp_matches(lower(substring(text, greatest(a - {context.STREET}, 0) + 1, a - greatest(a - {context.STREET}, 0))),
      '(?:^|[^\p{{L}}\p{{Nd}}])(?:{"|".join(x.replace(".", chr(92) + ".") for x in context.STREET_MARKERS)})\p{{L}}{{0,3}}(?:[^\p{{L}}]|$)') AS street,
      len(regexp_extract_all(value, '[\p{{Cyrillic}}\p{{Latin}}]+')) = 1 AND list_contains({context.COMMON_WORDS}, regexp_replace(translate(lower(trim(value)), 'ё', 'е'), '\s+', ' ', 'g')) AS common FROM v"""
)
def x_marked(spark, d):
    """Signs beside labelled spans: a kind of street right before, an ordinary word alone."""
    s = _labelled(spark, d).select("sample_id", "text", F.posexplode("spans").alias("pos", "s"))
    low = t.lower_same_width(F.col("text"))
    value = t.cut(F.col("text"), F.col("s.start"), F.col("s.end"))
    return s.select("sample_id", "pos", context.street_before(low, F.col("s")).alias("street"), context.common_word(value).alias("common"))


@query(
    f"""WITH {_SPANS}, i AS (SELECT sample_id, sum(length(regexp_replace(value, '[^0-9]', '', 'g'))) AS n FROM v GROUP BY 1)
    SELECT sample_id, (length(regexp_replace(text, '[^0-9]', '', 'g')) - coalesce(n, 0))::INT AS outside FROM samples LEFT JOIN i USING (sample_id) WHERE text <> '' AND NOT partial_labels"""
)
def a_outside_changes(spark, d):
    """What starring all digits changes outside the labelled spans."""
    s = _labelled(spark, d)
    changed = F.regexp_replace("text", "[0-9]", "*")
    return s.select("sample_id", quality.outside_changes(F.col("text"), changed, F.col("spans")).alias("outside"))


@query(
    rf"""WITH {_SPANS}, m AS (SELECT sample_id, type, value, regexp_replace(value, '[0-9]', '*', 'g') AS masked FROM v)
    SELECT sample_id, type, CASE WHEN length(value) = 0 THEN 1.0::DOUBLE ELSE list_sum(list_transform(generate_series(1, length(value)), lambda k: (substring(value, k, 1) <> substring(masked, k, 1))::INT)) / length(value)::DOUBLE END AS score FROM m"""
)
def a_mask_scores(spark, d):
    """How much of each labelled value starring its digits hides."""
    s = _labelled(spark, d).select("sample_id", "text", F.explode("spans").alias("s"))
    value = t.cut(F.col("text"), F.col("s.start"), F.col("s.end"))
    return s.select("sample_id", "s.type", quality.mask_score(value, F.regexp_replace(value, "[0-9]", "*")).alias("score"))


@query(
    """WITH x AS (SELECT system_id AS name, avg(took_ms) FILTER (capture_id % 2 = 0) AS now, avg(took_ms) FILTER (capture_id % 2 = 1) AS before FROM captures WHERE system_id IS NOT NULL GROUP BY 1)
    SELECT name, CASE WHEN now IS NULL OR before IS NULL THEN 'missing' WHEN now / before > 1.25 THEN 'slower' WHEN now / before < 0.75 THEN 'faster' ELSE 'ok' END AS verdict FROM x WHERE now IS NOT NULL OR before IS NOT NULL"""
)
def a_timing_gate(spark, d):
    """Mean times of one half of the requests against the other, by system."""
    c = table(spark, d, "captures").where("system_id is not null and took_ms is not null")
    half = lambda k: c.where(F.pmod("capture_id", F.lit(2)) == k).groupBy(F.col("system_id").alias("name")).agg(F.avg("took_ms").alias("ns"))
    return quality.timing_gate(half(0), half(1)).select("name", "verdict")


@query(
    """WITH f AS (SELECT payload_id, '[' || upper(trim(type)) || ']' AS token, value, found_at, fragment_id FROM fragments WHERE payload_id IS NOT NULL AND type IS NOT NULL),
    x AS (SELECT payload_id, token, value, (fragment_id % 2) AS fresh, row_number() OVER (PARTITION BY payload_id, token, fragment_id % 2 ORDER BY fragment_id) AS k FROM f)
    SELECT payload_id, token, arg_max(value, fresh) AS value FROM x WHERE k = 1 GROUP BY payload_id, token"""
)
def u_mappings(spark, d):
    """The placeholders of earlier and of new turns of a conversation as one map; the new ones win."""
    f = table(spark, d, "fragments").where("payload_id is not null and type is not null").select("payload_id", F.concat(F.lit("["), F.upper(F.trim("type")), F.lit("]")).alias("token"), "value", "fragment_id")
    side = lambda k: f.where(F.pmod("fragment_id", F.lit(2)) == k).groupBy("payload_id", "token").agg(F.min_by("value", "fragment_id").alias("value"))
    return chat.merged_mappings(side(0), side(1), "payload_id")


@query(
    r"""SELECT fragment_id, regexp_matches(value, '^(?:19|20)[0-9]{2}$') AS year, regexp_matches(value, '^(?:127\.|0\.0\.)') AS service,
    regexp_matches(lower(value), '^[авекмнорстух]{2}$') AS series, regexp_matches(regexp_extract(value, '\.([^.]*)$', 1), '^\p{L}{2,}$') AS zone FROM fragments"""
)
def v_shapes(spark, d):
    """Years, service addresses, standard series, domain zones."""
    x = F.col("value")
    zone = v.domain_zone(F.regexp_extract(x, r"\.([^.]*+)$", 0))
    return table(spark, d, "fragments").select("fragment_id", v.looks_like_year(x).alias("year"), v.service_ipv4(x).alias("service"), v.standard_series(F.lower(x)).alias("series"), zone.alias("zone"))


@query(
    r"""SELECT doc_id, regexp_matches(x, '^(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$') AS address, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+')) AS x FROM documents) GROUP BY ALL"""
)
def v_dotted_numbers(spark, d):
    """Which dotted numbers of the documents are network addresses."""
    x = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]++(?:\.[0-9]++)++"), F.lit(0))).alias("x"))
    return x.groupBy("doc_id", v.ipv4(F.col("x"), leading_zeros=True).alias("address")).agg(F.count("*").alias("n"))


_NEAR = ("номер", "карт", "тел", "счёт", "request", "order no")


@query(
    rf"""WITH a AS (SELECT doc_id, lower(text) AS low, length(regexp_extract(text, '^[^0-9]*')) AS p FROM documents WHERE regexp_matches(text, '[0-9]')),
    l AS (SELECT doc_id, substring(low, greatest(p - 24, 0) + 1, p - greatest(p - 24, 0)) AS l FROM a)
    SELECT doc_id, list_bool_or(list_transform({list(_NEAR)}, lambda w: contains(l, w))) OR list_bool_or(list_transform({[w.replace(" ", "") for w in _NEAR]}, lambda w: contains(translate(l, ' ' || chr(9) || chr(160), ''), w))) AS near FROM l"""
)
def t_anchor_before(spark, d):
    """Whether an anchor stands before the first digit of each document."""
    x = table(spark, d, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", t.lower_same_width(F.col("text")).alias("low"), F.length(F.regexp_extract("text", "^[^0-9]*+", 0)).alias("p"))
    return x.select("doc_id", t.anchor_before(F.col("low"), F.col("p"), _NEAR, 24).alias("near"))


@query(
    """SELECT fragment_id, lower(value) AS low, translate(value, 'abcehkmoptxyABCEHKMOPTXY', 'авсенкмортхуАВСЕНКМОРТХУ') AS series, coalesce(contains(lower(value), 'ул') OR contains(lower(value), 'инн') OR contains(lower(value), 'a'), NULL) AS any_word FROM fragments"""
)
def t_folds(spark, d):
    x = F.col("value")
    return table(spark, d, "fragments").select("fragment_id", t.lower_same_width(x).alias("low"), t.fold_series(x).alias("series"), t.contains_any(F.lower(x), ("ул", "инн", "a")).alias("any_word"))


@query(
    r"""SELECT sample_id::VARCHAR AS id, category, source, text, CASE WHEN len(spans) = 0 THEN '' ELSE array_to_string(list_transform(spans, lambda s: s.start_byte || '-' || s.end_byte || ':' || s.type), ',') END AS labels FROM samples WHERE text <> ''"""
)
def s_written(spark, d):
    """Labelled samples written as JSON lines and read back; the files lie in the shared folder."""
    path = scratch_path(spark, "labelled")
    s = table(spark, d, "samples").where("text <> ''")
    spans = F.transform("spans", lambda x: F.struct(x["start_byte"].alias("start"), x["end_byte"].alias("end"), x["type"].alias("type")))
    writers.dataset(s.select(F.col("sample_id").cast("string").alias("id"), "category", "source", "text", spans.alias("spans"), "partial_labels"), path)
    labels = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(":"), x["type"])), ",")
    return readers.labelled(spark, path).select("id", "category", "source", "text", labels.alias("labels"))


@query(
    """SELECT system_id, 'id:' || substring(sha256(payload_id), 1, 12) AS payload_id, strlen(text)::INT AS bytes, count(*) AS n FROM samples WHERE text IS NOT NULL GROUP BY ALL"""
)
def s_audit(spark, d):
    """Audit rows hold sizes and digests, never values."""
    s = table(spark, d, "samples").where("text is not null").select(F.col("system_id").alias("system"), "payload_id", F.col("text").alias("payload"), F.create_map().cast("map<string,int>").alias("counts"), F.lit(False).alias("degraded"))
    return writers.audit_rows(s, "mask").groupBy(F.col("system").alias("system_id"), "payload_id", "bytes").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT CASE WHEN took_ms IS NULL THEN 500 WHEN payload_id IS NULL THEN 422 WHEN direction LIKE 'mask%' THEN 200 ELSE 404 END AS status FROM captures)
    SELECT status, (status // 100) || 'xx' AS class, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM c GROUP BY status"""
)
def a_status(spark, d):
    """Requests by a status that their columns tell, with shares."""
    c = table(spark, d, "captures")
    status = F.when(F.col("took_ms").isNull(), 500).when(F.col("payload_id").isNull(), 422).when(F.col("direction").startswith("mask"), 200).otherwise(404)
    return metrics.status_counts(c.select(status.alias("status")), "status")


@query(
    r"""WITH s AS (SELECT coalesce(upper(trim(type)), '(none)') AS type, fragment_id, length(regexp_replace(value, '[^0-9]', '', 'g')) / greatest(length(value), 1)::DOUBLE AS share FROM fragments),
    r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY share, fragment_id) AS rank FROM s) SELECT type, fragment_id, share, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def k_worst_examples(spark, d):
    """The five values of each type that starring digits hides least: the limit is the feature."""
    f = table(spark, d, "fragments")
    share = F.length(t.digits_only(F.col("value"))) / F.greatest(F.length("value"), F.lit(1))
    s = f.select(F.coalesce(F.upper(F.trim("type")), F.lit("(none)")).alias("type"), "fragment_id", share.cast("double").alias("share"))
    return quality.worst_examples(s, ["type"], 5)


@query(
    """WITH r AS (SELECT source AS name, 100.0 * sum(n) / greatest(sum(length(text)), 1)::DOUBLE AS percent, half FROM (SELECT source, text, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n, sample_id % 2 AS half FROM samples WHERE text <> '') GROUP BY source, half),
    j AS (SELECT coalesce(a.name, b.name) AS name, a.percent AS now, b.percent AS before FROM (SELECT * FROM r WHERE half = 0) a FULL OUTER JOIN (SELECT * FROM r WHERE half = 1) b ON a.name = b.name)
    SELECT name, CASE WHEN now IS NULL THEN 'missing' WHEN before IS NULL THEN 'new' WHEN now > before + 0.5 THEN 'worse' ELSE 'ok' END AS verdict FROM j"""
)
def a_false_gate(spark, d):
    """Characters covered by digits, one half of the samples against the other, by source."""
    s = table(spark, d, "samples").where("text <> ''").select("sample_id", F.coalesce("source", F.lit(None)).alias("source"), "text")
    runs = F.transform(F.regexp_extract_all("text", F.lit("[0-9]"), F.lit(0)), lambda x: F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")))
    rates = lambda k: quality.false_rates(s.where(F.pmod("sample_id", F.lit(2)) == k).withColumn("kept", runs), "source", "text", "kept")
    return quality.false_gate(rates(0), rates(1)).select("name", "verdict")


@query()
def a_sample_scores(spark, d):
    """The whole path scored on the labelled samples: what of each labelled value is hidden, and what is hidden outside."""
    s = _labelled(spark, d).withColumnRenamed("spans", "gold")
    m = pipeline.mask(s, "text", "full")
    each = m.select("sample_id", "text", "masked", F.explode("gold").alias("s"))
    share = quality.changed_share(F.col("text"), F.col("masked"), F.col("s.start"), F.col("s.end"))
    return each.select("s.type", share.alias("share")).groupBy("type").agg(F.count("*").alias("spans"), F.round(F.avg("share"), 4).alias("hidden"))


@query("SELECT system_id, coalesce(preset, 'full') AS preset, CASE WHEN len(coalesce(types, [])) = 0 THEN 28 ELSE len(types) END::INT AS n_types, system_id <> 'crm' AS enabled FROM systems")
def m_listing(spark, d):
    """Systems with their policies after one of them was switched off."""
    s = policy.set_enabled(table(spark, d, "systems"), "crm", False)
    return policy.listing(s).join(s.select("system_id", "enabled"), "system_id").select("system_id", "preset", "n_types", "enabled")

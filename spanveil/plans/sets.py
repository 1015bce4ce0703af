"""Span algebra, masking presets and policies over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanveil.functions import text as t
from spanveil.functions import validators as v
from spanveil.operators import masking, policy, spans
from spanveil.plans.registry import query
from spanveil.runtime import spread, table
from spanveil.schema import ALL_TYPES, DOCUMENT, EXTRA, MANDATORY, PRIORITY

_TYPE = "upper(trim(type))"
_PRIORITY = "CASE type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in PRIORITY.items()) + " ELSE 0 END"


def _fragments(spark, d):
    return table(spark, d, "fragments").withColumn("type", F.upper(F.trim("type"))).where("type is not null and payload_id is not null")


def _conf():
    return F.element_at(F.array(F.lit(0.4), F.lit(0.6), F.lit(0.75), F.lit(0.9)), (F.pmod(F.length("value"), F.lit(4)) + 1).cast("int"))


@query(
    f"""WITH RECURSIVE s AS (SELECT DISTINCT payload_id, start_byte AS a, end_byte AS b, {_TYPE} AS type, [0.4, 0.6, 0.75, 0.9][length(value) % 4 + 1]::DOUBLE AS conf FROM fragments
        WHERE type IS NOT NULL AND payload_id IS NOT NULL AND [0.4, 0.6, 0.75, 0.9][length(value) % 4 + 1] >= 0.6),
    o AS (SELECT *, {_PRIORITY} AS pr, row_number() OVER (PARTITION BY payload_id ORDER BY a, b - a DESC, conf DESC, type) AS i FROM s WHERE a >= 0 AND b > a),
    fold AS (SELECT payload_id, i, i AS keeper, a, b, pr, conf, NULL::BIGINT AS done FROM o WHERE i = 1
      UNION ALL
      SELECT o.payload_id, o.i, CASE WHEN o.a < f.b AND NOT (o.b - o.a > f.b - f.a OR o.b - o.a = f.b - f.a AND (o.pr > f.pr OR o.pr = f.pr AND o.conf > f.conf)) THEN f.keeper ELSE o.i END,
        CASE WHEN o.a < f.b AND NOT (o.b - o.a > f.b - f.a OR o.b - o.a = f.b - f.a AND (o.pr > f.pr OR o.pr = f.pr AND o.conf > f.conf)) THEN f.a ELSE o.a END,
        CASE WHEN o.a < f.b AND NOT (o.b - o.a > f.b - f.a OR o.b - o.a = f.b - f.a AND (o.pr > f.pr OR o.pr = f.pr AND o.conf > f.conf)) THEN f.b ELSE o.b END,
        CASE WHEN o.a < f.b AND NOT (o.b - o.a > f.b - f.a OR o.b - o.a = f.b - f.a AND (o.pr > f.pr OR o.pr = f.pr AND o.conf > f.conf)) THEN f.pr ELSE o.pr END,
        CASE WHEN o.a < f.b AND NOT (o.b - o.a > f.b - f.a OR o.b - o.a = f.b - f.a AND (o.pr > f.pr OR o.pr = f.pr AND o.conf > f.conf)) THEN f.conf ELSE o.conf END,
        CASE WHEN o.a >= f.b THEN f.keeper END
      FROM fold f JOIN o ON o.payload_id = f.payload_id AND o.i = f.i + 1),
    last AS (SELECT payload_id, arg_max(keeper, i) AS k FROM fold GROUP BY payload_id),
    kept AS (SELECT payload_id, done AS k FROM fold WHERE done IS NOT NULL UNION SELECT payload_id, k FROM last)
    SELECT o.payload_id, o.a AS start_byte, o.b AS end_byte, o.type FROM kept JOIN o ON o.payload_id = kept.payload_id AND o.i = kept.k"""
)
def f_resolved(spark, d):
    """Spans of one payload resolved. A payload's spans are distinct and bounded by its text, so the array is small."""
    f = _fragments(spark, d).select("payload_id", "start_byte", "end_byte", "type", _conf().alias("conf")).distinct()
    sets = f.groupBy("payload_id").agg(F.array_sort(F.collect_set(F.struct(F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "type", "conf", F.lit("x").alias("reason")))).alias("s"))
    kept = sets.select("payload_id", F.explode(spans.resolved(F.expr("array_sort(s, (a, b) -> CASE WHEN a.type < b.type THEN -1 WHEN a.type > b.type THEN 1 ELSE 0 END)"), 0.6)["kept"]).alias("k"))
    return kept.select("payload_id", F.col("k.start").alias("start_byte"), F.col("k.end").alias("end_byte"), "k.type")


@query(
    f"""SELECT f.system_id, count(*) AS n, sum(CASE WHEN len(coalesce(s.types, [])) = 0 OR list_contains(s.types, {_TYPE.replace("type", "f.type")}) THEN 1 ELSE 0 END)::BIGINT AS allowed
    FROM fragments f LEFT JOIN systems s USING (system_id) WHERE f.type IS NOT NULL AND payload_id IS NOT NULL GROUP BY f.system_id"""
)
def f_allowed_types(spark, d):
    j = policy.joined(_fragments(spark, d).select("system_id", "type"), table(spark, d, "systems"))
    ok = (F.size("types") == 0) | F.array_contains("types", F.col("type"))
    return j.groupBy("system_id").agg(F.count("*").alias("n"), F.sum(F.when(ok, 1).otherwise(0)).alias("allowed"))


@query(f"SELECT payload_id, start_byte, end_byte, {_TYPE} AS type, count(*) AS n FROM fragments WHERE type IS NOT NULL AND payload_id IS NOT NULL GROUP BY ALL")
def f_distinct_spans(spark, d):
    return _fragments(spark, d).groupBy("payload_id", "start_byte", "end_byte", "type").agg(F.count("*").alias("n"))


@query(
    f"""WITH f AS (SELECT DISTINCT payload_id, {_TYPE} AS type, start_byte, end_byte FROM fragments WHERE type IS NOT NULL AND payload_id IS NOT NULL),
    r AS (SELECT *, max(end_byte) OVER (PARTITION BY payload_id, type ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_byte > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY payload_id, type ORDER BY start_byte, end_byte ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT payload_id, type, min(start_byte) AS start_byte, max(end_byte) AS end_byte, count(*) AS n_merged FROM i GROUP BY payload_id, type, island"""
)
def f_merged(spark, d):
    f = _fragments(spark, d).select("payload_id", "type", "start_byte", "end_byte").distinct()
    return spans.merged(f, ["payload_id"], gap=2)


@query(
    f"""WITH f AS (SELECT DISTINCT payload_id, {_TYPE} AS type, start_byte AS a, end_byte AS b FROM fragments WHERE type IS NOT NULL AND payload_id IS NOT NULL)
    SELECT x.type AS type_a, y.type AS type_b, count(*) AS n FROM f x JOIN f y ON x.payload_id = y.payload_id AND x.a < y.b AND y.a < x.b AND (x.a, x.b, x.type) < (y.a, y.b, y.type) GROUP BY ALL"""
)
def f_overlaps(spark, d):
    f = _fragments(spark, d).select("payload_id", F.col("type").alias("t"), F.col("start_byte").alias("a"), F.col("end_byte").alias("b")).distinct()
    x, y = f.alias("x"), f.alias("y")
    before = F.struct("x.a", "x.b", "x.t") < F.struct("y.a", "y.b", "y.t")
    j = x.join(y, (F.col("x.payload_id") == F.col("y.payload_id")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b")) & before)
    return j.groupBy(F.col("x.t").alias("type_a"), F.col("y.t").alias("type_b")).agg(F.count("*").alias("n"))


_PLAIN = r"regexp_replace(translate(lower(trim(value)), 'ё', 'е'), '[ \t\n\x0b\f\r]+', ' ', 'g')"


@query(f"SELECT fragment_id FROM fragments WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_PLAIN} AS p FROM known_values) k WHERE k.p = {_PLAIN.replace('value', 'fragments.value')})")
def f_not_on_file(spark, d):
    """Values that no allow-list entry equals: an anti-join on the compared form."""
    known = table(spark, d, "known_values").select(t.plain(F.col("value")).alias("p")).distinct()
    f = table(spark, d, "fragments").select("fragment_id", t.plain(F.col("value")).alias("p"))
    return f.join(known, "p", "left_anti").select("fragment_id")


@query(
    r"""SELECT fragment_id, type FROM fragments WHERE coalesce(upper(trim(type)), '') <> 'IP_ADDRESS'
    AND regexp_matches(value, '^(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$')"""
)
def f_network_addresses(spark, d):
    f = table(spark, d, "fragments").where(F.coalesce(F.upper(F.trim("type")), F.lit("")) != "IP_ADDRESS")
    return f.where(v.ipv4(F.col("value"), leading_zeros=True)).select("fragment_id", "type")


_WS = r"\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SOLID = r"length(regexp_replace({}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"


@query(
    rf"""SELECT fragment_id, repeat('*', length(value)) AS full_mask, regexp_replace(value, '[^{_WS}]', '*', 'g') AS full_ws,
    CASE WHEN {_SOLID.format("value")} < 6 THEN repeat('*', length(value)) ELSE array_to_string(list_transform(generate_series(1, length(value)), lambda i:
      CASE WHEN regexp_matches(substring(value, i, 1), '[\p{{L}}\p{{Nd}}]') AND {_SOLID.format("substring(value, 1, i - 1)")} >= 2 AND {_SOLID.format("substring(value, 1, i - 1)")} < {_SOLID.format("value")} - 2 THEN '*' ELSE substring(value, i, 1) END), '') END AS partial_mask,
    CASE WHEN len(regexp_extract_all(value, '\p{{L}}[\p{{L}}-]*')) = 0 THEN repeat('*', length(value))
      ELSE array_to_string(list_transform(regexp_extract_all(value, '\p{{L}}[\p{{L}}-]*'), lambda w: upper(substring(w, 1, 1)) || '.'), ' ') END AS initials FROM fragments"""
)
def m_presets(spark, d):
    x = F.col("value")
    return spread(table(spark, d, "fragments")).select("fragment_id", masking.full(x).alias("full_mask"), masking.full_ws(x).alias("full_ws"), masking.partial(x).alias("partial_mask"), masking.initials(x).alias("initials"))


@query(
    f"""WITH f AS (SELECT payload_id, {_TYPE} AS type, value, min(start_byte) AS first_at FROM fragments WHERE type IS NOT NULL AND payload_id IS NOT NULL GROUP BY ALL)
    SELECT payload_id, type, value, '[' || type || '_' || dense_rank() OVER (PARTITION BY payload_id, type ORDER BY first_at, value) || ']' AS token FROM f"""
)
def m_tokens(spark, d):
    """Placeholders numbered by first appearance, as a window over distinct values."""
    f = _fragments(spark, d).groupBy("payload_id", "type", "value").agg(F.min("start_byte").alias("first_at"))
    n = F.dense_rank().over(Window.partitionBy("payload_id", "type").orderBy("first_at", "value"))
    return f.select("payload_id", "type", "value", F.concat(F.lit("["), F.col("type"), F.lit("_"), n.cast("string"), F.lit("]")).alias("token"))


@query(
    r"""SELECT raw_id, length(regexp_replace(payload, '[^*]', '', 'g')) / greatest(length(regexp_replace(payload, '[ \t\n\x0b\f\r]', '', 'g')), 1) >= 0.5 AS stars,
    1 - length(regexp_replace(regexp_replace(payload, '\[[\p{Lu}_]+_[0-9]+\]', '', 'g'), '[ \t\n\x0b\f\r]', '', 'g')) / greatest(length(regexp_replace(payload, '[ \t\n\x0b\f\r]', '', 'g')), 1) >= 0.5 AND regexp_matches(payload, '[^ \t\n\x0b\f\r]') AS tokens FROM raw_samples"""
)
def m_looks_masked(spark, d):
    x = F.col("payload")
    return table(spark, d, "raw_samples").select("raw_id", masking.looks_masked(x, F.lit("full")).alias("stars"), masking.looks_masked(x, F.lit("token")).alias("tokens"))


@query(
    f"""WITH t AS (SELECT unnest({list(ALL_TYPES)}) AS type)
    SELECT s.system_id, t.type, CASE WHEN t.type IN {MANDATORY} THEN 'mandatory' WHEN t.type IN {DOCUMENT} THEN 'document' WHEN t.type IN {EXTRA} THEN 'extra' ELSE 'custom' END AS tier,
      CASE WHEN len(coalesce(s.types, [])) = 0 OR list_contains(s.types, t.type) THEN coalesce(s.preset, 'full') ELSE 'off' END AS cell FROM systems s CROSS JOIN t"""
)
def m_coverage(spark, d):
    return policy.coverage(table(spark, d, "systems"))


@query("SELECT system_id, coalesce(preset, 'full') AS preset, coalesce(min_conf, 0.6) AS min_conf, coalesce(date_mode, 'pii_context') AS date_mode, coalesce(on_unknown_id, '404') AS on_unknown_id, array_to_string(coalesce(types, []), ',') AS types FROM systems")
def m_systems(spark, d):
    return policy.with_defaults(table(spark, d, "systems")).withColumn("types", F.array_join("types", ","))


@query("SELECT sample_id, 'key:' || substring(sha256(payload_id), 1, 16) AS actor FROM samples")
def m_actors(spark, d):
    from spanveil.operators.metrics import actor

    return table(spark, d, "samples").select("sample_id", actor(F.col("payload_id")).alias("actor"))

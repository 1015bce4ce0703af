"""Scores, reports, quantiles, histograms, gates, samples of rows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.operators import corpus, generate, masking, metrics, quality
from spanveil.plans.registry import query
from spanveil.runtime import spread, table

_TYPE = "coalesce(upper(trim(type)), '(none)')"
_SHARE = r"""(length(pm) - length(replace(pm, '*', '')) - (length(value) - length(replace(value, '*', '')))) / greatest(length(value), 1)::DOUBLE"""
_SOLID = r"length(regexp_replace({}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"
_PARTIAL = rf"""CASE WHEN {_SOLID.format("value")} < 6 THEN repeat('*', length(value)) ELSE array_to_string(list_transform(generate_series(1, length(value)), lambda i:
      CASE WHEN regexp_matches(substring(value, i, 1), '[\p{{L}}\p{{Nd}}]') AND {_SOLID.format("substring(value, 1, i - 1)")} >= 2 AND {_SOLID.format("substring(value, 1, i - 1)")} < {_SOLID.format("value")} - 2 THEN '*' ELSE substring(value, i, 1) END), '') END"""


def _shares(spark, d):
    f = spread(table(spark, d, "fragments"))
    share = quality.changed_share(F.col("value"), masking.partial(F.col("value")), F.lit(0), F.length("value"))
    return f.select(F.coalesce(F.upper(F.trim("type")), F.lit("(none)")).alias("type"), "system_id", "found_at", share.alias("share"))


_CHANGED = f"""SELECT {_TYPE} AS type, system_id, found_at, list_sum(list_transform(generate_series(1, length(value)), lambda i: CASE WHEN substring(value, i, 1) <> substring(pm, i, 1) THEN 1 ELSE 0 END)) / length(value)::DOUBLE AS share
  FROM (SELECT *, {_PARTIAL} AS pm FROM fragments)"""


@query(
    f"""WITH s AS ({_CHANGED})
    SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(system_id) = 0 THEN 'category' ELSE 'all' END AS slice, coalesce(type, system_id, '(none)') AS name, count(*) AS fragments,
      round(avg(share), 6) AS mean_share, sum(CASE WHEN share > 0 THEN 1 ELSE 0 END)::BIGINT AS touched, sum(CASE WHEN share = 0 THEN 1 ELSE 0 END)::BIGINT AS missed,
      sum(CASE WHEN share > 0 AND share < 1 THEN 1 ELSE 0 END)::BIGINT AS partial, sum(CASE WHEN share = 1 THEN 1 ELSE 0 END)::BIGINT AS "full"
    FROM s GROUP BY GROUPING SETS ((type), (system_id), ())"""
)
def a_scores(spark, d):
    """Changed shares of the partial preset by type, by system and in all, in one pass."""
    s = _shares(spark, d).select("type", F.col("system_id").alias("category"), F.lit("fragments").alias("source"), "share")
    return quality.scored(s).where("slice <> 'source'")


@query(
    f"""WITH s AS ({_CHANGED}), n AS (SELECT type AS name, round(avg(share), 6) AS now FROM s WHERE found_at >= TIMESTAMP '2025-07-01' GROUP BY 1),
    b AS (SELECT type AS name, round(avg(share), 6) AS before FROM s WHERE found_at < TIMESTAMP '2025-07-01' GROUP BY 1)
    SELECT 'type' AS slice, coalesce(n.name, b.name) AS name, now, before, CASE WHEN now IS NULL THEN 'missing' WHEN before IS NULL THEN 'new' WHEN now < before - 0.005 THEN 'worse' ELSE 'ok' END AS verdict
    FROM n FULL OUTER JOIN b ON n.name = b.name"""
)
def a_gate(spark, d):
    """The newer half against the older as baseline: a full outer join."""
    s = _shares(spark, d)
    part = lambda c: s.where(c).groupBy(F.lit("type").alias("slice"), F.col("type").alias("name")).agg(F.round(F.avg("share"), 6).alias("mean_share"))
    return quality.quality_gate(part("found_at >= timestamp '2025-07-01'"), part("found_at < timestamp '2025-07-01'"))


@query("""SELECT sample_id, levenshtein(payload_id, system_id) / greatest(length(payload_id), length(system_id), 1)::DOUBLE AS distance FROM samples""")
def a_levenshtein(spark, d):
    return table(spark, d, "samples").select("sample_id", quality.normalized_levenshtein(F.col("payload_id"), F.col("system_id")).alias("distance"))


@query(
    """SELECT system_id, count(*) AS n, list_sort(list(took_ms))[floor(0.5 * (count(*) - 1))::INT + 1] AS p50, list_sort(list(took_ms))[floor(0.95 * (count(*) - 1))::INT + 1] AS p95,
    list_sort(list(took_ms))[floor(0.99 * (count(*) - 1))::INT + 1] AS p99 FROM captures WHERE took_ms IS NOT NULL GROUP BY 1"""
)
def a_quantiles(spark, d):
    return quality.exact_quantiles(table(spark, d, "captures"), "system_id", "took_ms", (0.5, 0.95, 0.99))


@query(
    f"""WITH b AS (SELECT unnest({list(metrics.BUCKETS)}::DOUBLE[] || ['inf'::DOUBLE]) AS le), k AS (SELECT DISTINCT direction FROM captures WHERE took_ms IS NOT NULL)
    SELECT k.direction, b.le, count(c.took_ms) AS n FROM k CROSS JOIN b LEFT JOIN captures c ON c.direction = k.direction AND c.took_ms <= b.le GROUP BY ALL"""
)
def a_histogram(spark, d):
    return metrics.histogram(table(spark, d, "captures"), ["direction"], "took_ms")


@query(
    """WITH s AS (SELECT *, CASE WHEN took_ms IS NULL THEN 'neutral' WHEN took_ms > 1 THEN 'bad' ELSE 'good' END AS s FROM captures),
    b AS (SELECT system_id, s, sum(CASE WHEN s = 'good' THEN 1 ELSE 0 END) OVER (PARTITION BY system_id ORDER BY captured_at, capture_id ROWS UNBOUNDED PRECEDING) AS block FROM s WHERE s <> 'neutral'),
    r AS (SELECT system_id, block, count(*) AS run FROM b WHERE s = 'bad' GROUP BY ALL)
    SELECT system_id, max(run) AS longest FROM r GROUP BY 1"""
)
def a_longest_run(spark, d):
    state = F.when(F.col("took_ms").isNull(), "neutral").when(F.col("took_ms") > 1, "bad").otherwise("good")
    return quality.longest_bad_run(table(spark, d, "captures"), ["system_id"], ["captured_at", "capture_id"], state)


@query(
    """SELECT direction, count(*) AS n, min(payload_len) AS shortest, max(payload_len) AS longest, round(avg(payload_len), 4) AS mean_length,
    sum(CASE WHEN counts IS NULL OR cardinality(counts) = 0 THEN 1 ELSE 0 END)::BIGINT AS no_finding, sum(coalesce(list_sum(map_values(counts)), 0))::BIGINT AS findings FROM captures GROUP BY 1"""
)
def a_capture_report(spark, d):
    return corpus.capture_report(table(spark, d, "captures"))


@query("SELECT type, sum(n)::BIGINT AS findings FROM (SELECT unnest(map_keys(counts)) AS type, unnest(map_values(counts)) AS n FROM captures) GROUP BY 1")
def a_findings_by_type(spark, d):
    return corpus.findings_by_type(table(spark, d, "captures"))


@query(
    """SELECT coalesce(category, '(all)') AS category, coalesce(source, '(all)') AS source, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, sum(len(spans))::BIGINT AS n_spans
    FROM (SELECT coalesce(lower(trim(category)), '(none)') AS category, coalesce(source, '(none)') AS source, text, spans FROM samples) GROUP BY CUBE (category, source)"""
)
def a_dataset_stats(spark, d):
    s = table(spark, d, "samples").select(F.coalesce(F.lower(F.trim("category")), F.lit("(none)")).alias("category"), F.coalesce("source", F.lit("(none)")).alias("source"), F.length("text").alias("n"), F.size("spans").alias("k"))
    c = s.cube("category", "source").agg(F.count("*").alias("rows"), F.round(F.avg("n"), 4).alias("mean_chars"), F.sum("k").alias("n_spans"))
    return c.select(F.coalesce("category", F.lit("(all)")).alias("category"), F.coalesce("source", F.lit("(all)")).alias("source"), F.col("rows").alias("n"), "mean_chars", "n_spans")


_LANGS = ("ru", "en", "kk", "und")


@query("SELECT coalesce(source, '(none)') AS source, " + ", ".join(f"coalesce(sum(CASE WHEN lang = '{x}' THEN 1 ELSE 0 END), 0)::BIGINT AS {x}" for x in _LANGS) + " FROM documents GROUP BY 1")
def a_source_by_language(spark, d):
    p = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).pivot("lang", list(_LANGS)).count()
    return p.fillna(0)


@query("SELECT system_id, coalesce(upper(trim(type)), '(none)') AS type, count(*) AS n FROM fragments GROUP BY ALL")
def a_tallies(spark, d):
    return corpus.tallies(table(spark, d, "fragments").select("system_id", F.coalesce(F.upper(F.trim("type")), F.lit("(none)")).alias("type")), "system_id", "type")


@query(f"SELECT payload_id, string_agg(type || '=' || n, ',' ORDER BY type) AS counts FROM (SELECT payload_id, {_TYPE} AS type, count(*) AS n FROM fragments GROUP BY ALL) GROUP BY 1")
def a_counts_by_text(spark, d):
    f = table(spark, d, "fragments").groupBy("payload_id", F.coalesce(F.upper(F.trim("type")), F.lit("(none)")).alias("type")).agg(F.count("*").alias("n"))
    return f.groupBy("payload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string"))), ",").alias("counts"))


@query(
    """WITH r AS (SELECT sample_id, source, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS turn FROM samples)
    SELECT sample_id, source, turn FROM r ORDER BY turn, source NULLS FIRST, sample_id LIMIT 300"""
)
def k_round_robin(spark, d):
    """300 rows, one from each source in turn: the limit is the feature."""
    return corpus.round_robin(table(spark, d, "samples").select("sample_id", "source"), "source", "sample_id", 300).select("sample_id", "source", F.col("turn").cast("long").alias("turn"))


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL ORDER BY n_bytes DESC, doc_id LIMIT 20")
def k_longest_documents(spark, d):
    """A top-k report."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).orderBy(F.desc("n_bytes"), "doc_id").limit(20)


@query("SELECT (sample_id * 7 + 3) % 20 < 3 AS held_out, count(*) AS n FROM samples GROUP BY 1")
def k_holdout(spark, d):
    return table(spark, d, "samples").groupBy(corpus.holdout(F.col("sample_id")).alias("held_out")).agg(F.count("*").alias("n"))


@query("SELECT sample_id, category, md5('7:' || sample_id) AS place FROM samples")
def k_shuffled(spark, d):
    """A shuffle by seed and id; rows come in the order of `place`."""
    return corpus.shuffled(table(spark, d, "samples").select("sample_id", "category", corpus.shuffle_key("sample_id", 7).alias("place")), "sample_id", 7)


@query(
    """WITH a AS (SELECT 0 AS f, sample_id AS pos, payload_id, coalesce(source, 'synthetic') AS source, text FROM samples
      UNION ALL SELECT 1, raw_id, coalesce(payload_id, id), 'raw', coalesce(payload, text) FROM raw_samples)
    SELECT payload_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY f, pos) AS rn FROM a) WHERE rn = 1"""
)
def u_merged(spark, d):
    """Two corpora put together; of a repeated id the first corpus' first row stays."""
    a = table(spark, d, "samples").select("payload_id", F.col("sample_id").alias("pos"), "source", "text")
    b = table(spark, d, "raw_samples").select(F.coalesce("payload_id", "id").alias("payload_id"), F.col("raw_id").alias("pos"), F.lit(None).cast("string").alias("source"), F.coalesce("payload", "text").alias("text"))
    return corpus.merged([("synthetic", a), ("raw", b)], "payload_id", "pos").select("payload_id", "source", "text")


@query(
    r"""WITH s AS (SELECT doc_id, text, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS sentence FROM (SELECT doc_id, text,
      list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?;])([ \t\n\x0b\f\r])', '\1' || chr(1) || '\2', 'g'), '\x01|\n'), lambda x: regexp_replace(x, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')), lambda x: x <> '') AS p FROM documents)),
    g AS (SELECT sentence, min((doc_id, pos)) AS x FROM s WHERE length(sentence) BETWEEN 40 AND 300 AND NOT regexp_matches(sentence, '[0-9@]') AND regexp_matches(sentence, '[.!?]$') GROUP BY 1),
    r AS (SELECT x[1] AS doc_id, x[2] AS pos, sentence, row_number() OVER (PARTITION BY x[1] ORDER BY x[2]) AS n FROM g)
    SELECT doc_id, pos::INT AS pos, sentence FROM r WHERE n <= 5"""
)
def n_carriers(spark, d):
    """Sentences fit to carry labelled values, at most five of a page."""
    return corpus.carriers(table(spark, d, "documents"), "doc_id", "text", 5)


@query()
def n_injected(spark, d):
    values = [("PHONE", "+7 916 123-45-67"), ("EMAIL", "user@example.com"), ("FIO", "Лугов Иван Петрович"), ("CARD", "4111 1111 1111 1111")]
    c = corpus.carriers(table(spark, d, "documents"), "doc_id", "text", 1)
    return corpus.injected(c, "doc_id", "sentence", values)


@query()
def n_generated(spark, d):
    """A generated corpus of 5000 labelled texts; the size is the operator's parameter."""
    return generate.generated(spark, 5000, seed=3).select("id", "category", "text", F.size("spans").alias("n_spans"))


@query(
    r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?;])([ \t\n\x0b\f\r])', '\1' || chr(1) || '\2', 'g'), '\x01|\n'),
        lambda x: regexp_replace(x, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, s, 1 AS i, s[1] AS held, NULL::VARCHAR AS done FROM s WHERE len(s) > 0
      UNION ALL SELECT doc_id, s, i + 1, CASE WHEN closed THEN s[i + 1] ELSE joined END, CASE WHEN closed THEN held END
      FROM (SELECT *, held || ' ' || s[i + 1] AS joined, length(held || ' ' || s[i + 1]) > 300 AND length(held) >= 40 AS closed FROM f WHERE i < len(s))),
    p AS (SELECT doc_id, i, done AS piece FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, held FROM f WHERE i = len(s) AND length(held) >= 40)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, piece FROM p"""
)
def n_fragmented(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(corpus.fragmented(F.col("text"))).alias("pos", "piece"))


@query()
def n_recall(spark, d):
    """Generated texts masked, and their labelled spans scored: changed share by type."""
    from spanveil.operators import pipeline

    g = generate.generated(spark, 3000, seed=5)
    m = pipeline.mask(g.select("id", "text", "spans").withColumnRenamed("spans", "gold"), "text")
    x = m.select("text", "masked", F.explode("gold").alias("g"))
    c = quality.char_span(F.col("text"), F.col("g.start_byte"), F.col("g.end_byte"))
    x = x.withColumn("c", c)
    x = x.select(F.col("g.type").alias("type"), quality.changed_share(F.col("text"), F.col("masked"), F.col("c.start"), F.col("c.end")).alias("share"))
    return x.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("share"), 4).alias("mean_share")).orderBy("mean_share", "type")



"""Sources, mappings, request logs and windows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.operators import corpus, mapping, metrics, policy
from spanveil.plans.registry import query
from spanveil.runtime import durable, scratch_path, table
from spanveil.schema import SPANS
from spanveil.sources import readers
from spanveil.streaming import requests

KEY = "0123456789abcdef"


@query("SELECT coalesce(payload_id, id) AS payload_id, coalesce(payload, text) AS payload, count(*) AS n FROM raw_samples GROUP BY ALL")
def s_aliased(spark, d):
    """Records under whichever of their names they use."""
    r = table(spark, d, "raw_samples")
    return r.select(F.coalesce("payload_id", "id").alias("payload_id"), F.coalesce("payload", "text").alias("payload")).groupBy("payload_id", "payload").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT payload_id, arg_min(text, sample_id) AS text FROM samples WHERE text IS NOT NULL GROUP BY 1)
    SELECT f.fragment_id, strlen(substring(s.text, 1, instr(s.text, f.value) - 1))::INT AS start_byte, (strlen(substring(s.text, 1, instr(s.text, f.value) - 1)) + strlen(f.value))::INT AS end_byte
    FROM fragments f JOIN s USING (payload_id) WHERE instr(s.text, f.value) > 0"""
)
def s_bounds_by_value(spark, d):
    """Fragments without offsets, placed where their value first stands in the text of their payload."""
    s = table(spark, d, "samples").where("text is not null").groupBy("payload_id").agg(F.min_by("text", "sample_id").alias("text"))
    f = table(spark, d, "fragments").select("fragment_id", "payload_id", "value", "type").join(s, "payload_id")
    none = F.lit(None).cast("int")
    b = f.select("fragment_id", readers.span_bounds(F.col("text"), none, none, F.col("value"), F.col("type")).alias("b")).where("b is not null")
    return b.select("fragment_id", "b.start_byte", "b.end_byte")


@query(
    """WITH c AS (SELECT payload_id, min((captured_at, capture_id, system_id)) AS x FROM captures WHERE direction LIKE 'mask%' AND payload_id IS NOT NULL GROUP BY 1),
    s AS (SELECT payload_id, arg_min(text, sample_id) AS text FROM samples WHERE coalesce(text, '') <> '' GROUP BY 1)
    SELECT payload_id, x[1] AS captured_at, x[2] AS capture_id, x[3] AS system_id, text FROM c JOIN s USING (payload_id)"""
)
def s_capture_corpus(spark, d):
    return corpus.capture_corpus(table(spark, d, "captures"), table(spark, d, "samples"))


@query(
    """WITH b AS (SELECT system_id, CASE WHEN length(system_id) % 3 = 0 THEN 'sometimes' ELSE date_mode END AS date_mode, CASE WHEN length(system_id) % 2 = 0 THEN 'blur' ELSE preset END AS preset FROM systems)
    SELECT system_id, 'date_mode' AS fault FROM b WHERE coalesce(date_mode, 'pii_context') NOT IN ('pii_context', 'anchor_only', 'any', 'all') AND coalesce(preset, 'full') IN ('full', 'full_ws', 'partial', 'initials', 'token', 'synthetic')
    UNION ALL SELECT system_id, 'preset' FROM b WHERE coalesce(preset, 'full') NOT IN ('full', 'full_ws', 'partial', 'initials', 'token', 'synthetic')"""
)
def s_policy_faults(spark, d):
    """Faults of policies, a part of which is made faulty first."""
    s, n = table(spark, d, "systems"), F.length("system_id")
    s = s.withColumn("date_mode", F.when(n % 3 == 0, "sometimes").otherwise(F.col("date_mode"))).withColumn("preset", F.when(n % 2 == 0, "blur").otherwise(F.col("preset")))
    return policy.faults(s)


@query(
    """WITH f AS (SELECT payload_id, arg_min(text, sample_id) AS text FROM samples WHERE text <> '' AND payload_id IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS p, count(*) FILTER (regexp_matches(text, '[0-9]')) AS m FROM f)
    SELECT * FROM (SELECT 'mask_retry' AS action, 200 AS status, p + 2 * (p - m) AS n FROM n UNION ALL SELECT 'demask', 200, m FROM n UNION ALL SELECT 'forbidden', 403, m FROM n UNION ALL SELECT 'mask_store', 200, p FROM n
      UNION ALL SELECT 'ambiguous', 200, p FROM n) WHERE n > 0"""
)
def w_routed(spark, d):
    """Each text arrives twice, then its mask comes back, from its own system and from another, then another text under
    its id, then it comes under an unknown id: what is done with each. Masks star the digits here. The mappings are built
    first and kept in the shared folder, as their cipher differs with every run."""
    systems = table(spark, d, "systems")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    first = table(spark, d, "samples").where("text <> '' and payload_id is not null").groupBy("payload_id").agg(F.min(F.struct("sample_id", "system_id", "text")).alias("x"))
    r = first.select("payload_id", F.coalesce("x.system_id", F.lit("none")).alias("system"), F.col("x.text").alias("payload"))
    masked = r.withColumn("masked", F.regexp_replace("payload", "[0-9]", "*")).withColumn("kept", F.array().cast(SPANS)).withColumn("degraded", F.lit(False))
    store = durable(mapping.mappings_of(masked, KEY, now))
    back = store.select("payload_id", "system", F.col("mask").alias("payload"))
    foreign = back.withColumn("system", F.lit("another"))
    other = r.withColumn("payload", F.concat("payload", F.lit(" и ещё")))
    unknown = r.withColumn("payload_id", F.concat("payload_id", F.lit("?")))
    every = r.unionByName(back).unionByName(foreign).unionByName(other).unionByName(unknown)
    asked = policy.joined(every, systems, "system").withColumn("demask", F.lit(True)).withColumn("preset", F.lit("full"))
    return mapping.routed(asked, store, KEY, now).groupBy("action", "status").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE r AS (SELECT payload_id, text, epoch_ms(created_at) AS at_, row_number() OVER (PARTITION BY payload_id ORDER BY created_at, sample_id) AS k FROM samples WHERE payload_id IS NOT NULL AND text <> ''),
    f AS (SELECT payload_id, k, text AS orig, at_ + 900000 AS expires, 'mask_store' AS action FROM r WHERE k = 1
      UNION ALL SELECT r.payload_id, r.k, CASE WHEN f.expires <= r.at_ THEN r.text ELSE f.orig END, CASE WHEN f.expires <= r.at_ THEN r.at_ + 900000 ELSE f.expires END,
        CASE WHEN f.expires <= r.at_ THEN 'mask_store' WHEN r.text = f.orig THEN 'mask_retry' ELSE 'ambiguous' END FROM f JOIN r ON r.payload_id = f.payload_id AND r.k = f.k + 1)
    SELECT action, count(*) AS n FROM f GROUP BY 1"""
)
def w_streamed(spark, d):
    """The request flow as a stream over the samples, worked off to its end: masked without state, then decided with
    state by payload_id. The output and the checkpoint lie in the shared folder."""
    out = scratch_path(spark, "flow")
    source = spark.readStream.schema(table(spark, d, "samples").schema).parquet(f"{d}/samples.parquet*")
    asked = source.where("payload_id is not null and text <> ''").select("payload_id", F.col("system_id").alias("system"), F.col("text").alias("payload"), F.col("created_at").cast("timestamp").alias("at"))
    flow = requests.flow(requests.masked_requests(asked.withWatermark("at", "1 hour")))
    q = flow.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(requests.OUT).parquet(f"{out}/rows").groupBy("action").agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 5 SECOND, captured_at) - INTERVAL 10 SECOND, time_bucket(INTERVAL 5 SECOND, captured_at), INTERVAL 5 SECOND)) AS window_start, payload_len FROM captures)
    SELECT window_start, sum(payload_len)::BIGINT AS total FROM w GROUP BY 1"""
)
def w_load(spark, d):
    """Sliding load: fifteen seconds, every five."""
    return metrics.sliding_sum(table(spark, d, "captures"), "captured_at", F.col("payload_len"), "15 seconds", "5 seconds")


_BOUNDS = [0.0, *metrics.BUCKETS]
_COUNTS = ", ".join(f"count(*) FILTER (took_ms > {lo} AND took_ms <= {hi}) AS b{i}" for i, (lo, hi) in enumerate(zip(_BOUNDS, _BOUNDS[1:])))
_BELOW = lambda i: " + ".join(["0", *[f"b{k}" for k in range(i)]])
_LATENCY = " ".join(f"WHEN {_BELOW(i + 1)} >= 0.95::DOUBLE * n THEN {lo}::DOUBLE + {hi - lo}::DOUBLE * (0.95::DOUBLE * n - ({_BELOW(i)})) / greatest(b{i}, 1)" for i, (lo, hi) in enumerate(zip(_BOUNDS, _BOUNDS[1:])))


@query(
    f"""WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 20 SECOND, captured_at) - INTERVAL 40 SECOND, time_bucket(INTERVAL 20 SECOND, captured_at), INTERVAL 20 SECOND)) AS window_start, took_ms FROM captures WHERE took_ms IS NOT NULL),
    g AS (SELECT window_start, count(*) AS n, {_COUNTS} FROM w GROUP BY 1)
    SELECT window_start, n, CASE {_LATENCY} ELSE {metrics.BUCKETS[-1]}::DOUBLE END AS quantile FROM g"""
)
def w_latency(spark, d):
    """A sliding quantile from histogram buckets."""
    return metrics.sliding_quantile(table(spark, d, "captures"), "captured_at", "took_ms", 0.95, "60 seconds", "20 seconds")


@query(
    """SELECT system_id, direction, min(captured_at) AS first_at, count(*) - 1 AS suppressed FROM captures GROUP BY time_bucket(INTERVAL 10 SECOND, captured_at), system_id, direction"""
)
def w_repeats(spark, d):
    return metrics.repeats_suppressed(table(spark, d, "captures"), "captured_at", ["system_id", "direction"])


@query("SELECT capture_id, took_ms, count(*) AS n FROM captures WHERE took_ms IS NULL OR took_ms > 1.2 OR capture_id % 10 = 0 GROUP BY ALL")
def w_log_sample(spark, d):
    """One in ten ordinary requests, slow and failed ones all: the sampling is the feature."""
    c = metrics.sampled(table(spark, d, "captures"), F.col("capture_id"), 10, F.col("took_ms").isNull() | (F.col("took_ms") > 1.2))
    return c.groupBy("capture_id", "took_ms").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT payload_id, text, received_at, epoch_us(received_at) - lag(epoch_us(received_at)) OVER (PARTITION BY payload_id, text ORDER BY received_at) AS gap
      FROM (SELECT coalesce(payload_id, id) AS payload_id, coalesce(payload, text, '') AS text, received_at FROM raw_samples))
    SELECT (gap IS NULL OR gap > 86400000000) AS leader, count(*) AS n FROM g GROUP BY 1"""
)
def w_coalesced(spark, d):
    r = table(spark, d, "raw_samples").select(F.coalesce("payload_id", "id").alias("payload_id"), F.coalesce("payload", "text", F.lit("")).alias("payload"), "received_at")
    return mapping.coalesced(r, "received_at", 86_400).groupBy("leader").agg(F.count("*").alias("n"))


@query("SELECT capture_id, captured_at FROM captures ORDER BY captured_at DESC, capture_id LIMIT 1000")
def w_evicted(spark, d):
    """A store at capacity keeps what expires last: the limit is the feature."""
    c = table(spark, d, "captures").select(F.col("capture_id").alias("payload_id"), F.col("captured_at").alias("expires_at"))
    return mapping.kept_at_capacity(c, 1000).select(F.col("payload_id").alias("capture_id"), F.col("expires_at").alias("captured_at"))


@query(
    """SELECT system_id, sum((0.57::DOUBLE + 1.56::DOUBLE * payload_len / 1024) * CASE WHEN payload_len > 2048 THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END) / (1000.0 * 24 * 3600)::DOUBLE AS ratio FROM captures GROUP BY 1"""
)
def w_capacity(spark, d):
    return table(spark, d, "captures").groupBy("system_id").agg(metrics.capacity_ratio(F.col("payload_len"), 24, 3600.0).alias("ratio"))


@query(
    r"""WITH v AS (SELECT sample_id, regexp_replace(regexp_replace(regexp_replace(text, '[\p{L}\p{Nd}._+-]+@[\p{L}\p{Nd}.-]+', '[email]', 'g'), '\+?[0-9](?:[ .()-]?[0-9]){5,}', '[number]', 'g'),
      '[А-ЯЁ][а-яё]+[ \t\n\x0b\f\r]+[А-ЯЁ][а-яё]+(?:[ \t\n\x0b\f\r]+[А-ЯЁ][а-яё]+)?', '[name]', 'g') AS v FROM samples),
    w AS (SELECT sample_id, regexp_replace(regexp_replace(regexp_replace(v, '([^\p{L}\p{Nd}_])', '\1' || chr(1), 'g'), '(^|[^\p{L}\p{Nd}_])[A-Z]{2,}(?:[ \t\n\x0b\f\r]\x01)+[A-Z]{2,}($|[^\p{L}\p{Nd}_])', '\1[name]\2', 'g'), '\x01', '', 'g') AS v FROM v)
    SELECT sample_id, CASE WHEN strlen(v) > 512 THEN substring(v, 1, 128) || '…' ELSE v END AS value FROM w"""
)
def w_log_values(spark, d):
    return table(spark, d, "samples").select("sample_id", metrics.redacted_log_value(F.col("text")).alias("value"))

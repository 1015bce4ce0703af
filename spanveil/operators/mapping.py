"""Reversible mappings: which way a request goes, storing with expiry, restoring; batch form. The streaming form keeps
the same state by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.operators.masking import looks_masked

#: Seconds a mapping lives unless told otherwise.
TTL_SECONDS = 900


def hash_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def sealed(text: Column, key: str) -> Column:
    """The original encrypted with AES-GCM under a 16, 24 or 32 byte key."""
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"))


def opened(cipher: Column, key: str) -> Column:
    """NULL where it cannot be decrypted."""
    return F.try_aes_decrypt(cipher, F.lit(key), F.lit("GCM")).cast("string")


def mappings_of(masked: DataFrame, key: str, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Mapping rows of masked requests (payload_id, system, payload, masked, kept). Values are stored encrypted only;
    degraded results are not stored."""
    live = masked.where(~F.col("degraded"))
    return live.select(
        "payload_id", "system", F.col("masked").alias("mask"), hash_of(F.col("payload")).alias("orig_hash"), hash_of(F.col("masked")).alias("mask_hash"),
        F.transform("kept", lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"))).alias("span_meta"),
        sealed(F.col("payload"), key).alias("orig_ct"), (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
    )


def routed(requests: DataFrame, mappings: DataFrame, key: str, now: Column) -> DataFrame:
    """Decides for each request (payload_id, system, payload, preset, on_unknown_id, demask): mask and store, repeat
    the stored mask, restore, refuse, pass through, or mask without storing. One join; a payload_id that holds a third
    of all requests is split by AQE, mappings have one row for each id."""
    live = mappings.where(F.col("expires_at") > now).select("payload_id", F.col("system").alias("owner"), "mask", "orig_hash", "mask_hash", "orig_ct")
    j = requests.join(live, "payload_id", "left")
    stored, h = F.col("owner").isNotNull(), hash_of(F.col("payload"))
    original = opened(F.col("orig_ct"), key)
    own = (F.col("owner") == F.col("system")) & F.coalesce(F.col("demask"), F.lit(True))
    action = (
        F.when(stored & original.isNull(), "corrupted").when(~stored & ~looks_masked(F.col("payload"), F.col("preset")), "mask_store")
        .when(~stored & (F.col("on_unknown_id") == "passthrough"), "passthrough").when(~stored, "not_found")
        .when(F.col("orig_hash") == h, "mask_retry").when((F.col("mask_hash") == h) & own, "demask").when(F.col("mask_hash") == h, "forbidden").otherwise("ambiguous")
    )
    j = j.withColumn("action", action)
    status = F.create_map(*[F.lit(x) for x in ("corrupted", 409, "not_found", 404, "forbidden", 403)])
    return j.select(
        "payload_id", "system", "payload", "action", F.coalesce(F.try_element_at(status, F.col("action")), F.lit(200)).alias("status"),
        F.when(F.col("action") == "demask", original).when(F.col("action") == "mask_retry", F.col("mask")).when(F.col("action") == "passthrough", F.col("payload")).alias("result"),
    )


def upserted(mappings: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Mappings after writes: expired rows go, a new row replaces the old one of its id."""
    live = mappings.where(F.col("expires_at") > now)
    return live.join(new.select("payload_id"), "payload_id", "left_anti").unionByName(new)


def deleted(mappings: DataFrame, ids: DataFrame) -> DataFrame:
    return mappings.join(ids.select("payload_id").distinct(), "payload_id", "left_anti")


def kept_at_capacity(mappings: DataFrame, capacity: int) -> DataFrame:
    """At most `capacity` mappings: those that expire last, ties by id. A global sort and limit, no single window."""
    return mappings.orderBy(F.desc("expires_at"), "payload_id").limit(capacity)


def coalesced(requests: DataFrame, by: str, seconds: int) -> DataFrame:
    """One request for equal (payload_id, text) within a span of time; the first counts for the others."""
    w = Window.partitionBy("payload_id", hash_of(F.col("payload"))).orderBy(by)
    gap = F.unix_micros(F.col(by).cast("timestamp")) - F.unix_micros(F.lag(by).over(w).cast("timestamp"))
    return requests.withColumn("leader", gap.isNull() | (gap > seconds * 1_000_000))

"""Request flow as Structured Streaming: state by payload_id with expiry, coalescing of equal requests, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanveil.operators import pipeline, policy
from spanveil.operators.mapping import TTL_SECONDS

OUT = "payload_id string, system string, action string, result string"
STATE = "owner string, mask string, orig string, expires_ms long"


def masked_requests(requests: DataFrame, preset: str = "full") -> DataFrame:
    """Requests (payload_id, system, payload, at) with their mask; stateless, so it runs before the state by key."""
    return pipeline.mask(requests, "payload", preset).select("payload_id", "system", "payload", "at", "masked")


def flow(masked: DataFrame, ttl_seconds: int = TTL_SECONDS, demask: bool = True) -> DataFrame:
    """The same decisions as the batch form, with the mapping kept as state by payload_id until it expires by event
    time. Needs a watermark on `at`. One id's requests are worked off in order of their time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        known = state.get if state.exists else None
        out = []
        for r in rows.itertuples(index=False):
            now = int(r.at.value // 1_000_000)
            if known and known[3] <= now:
                known = None
            if known is None:
                if _starry(r.payload):
                    out.append((key[0], r.system, "not_found", None))
                    continue
                known = (r.system, r.masked, r.payload, now + ttl_seconds * 1000)
                out.append((key[0], r.system, "mask_store", r.masked))
            elif r.payload == known[2]:
                out.append((key[0], r.system, "mask_retry", known[1]))
            elif r.payload == known[1]:
                own = demask and r.system == known[0]
                out.append((key[0], r.system, "demask" if own else "forbidden", known[2] if own else None))
            else:
                out.append((key[0], r.system, "ambiguous", r.masked))
        if known is None:
            if state.exists:
                state.remove()
        else:
            state.update(known)
            state.setTimeoutTimestamp(max(known[3], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["payload_id", "system", "action", "result"])

    return masked.groupBy("payload_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def masked_by_rules(requests: DataFrame, rules_path: str, write, checkpoint: str):
    """A streaming query that reads the table of rules anew for each batch, so that edits hold from the next one on.
    `write` takes the masked batch and its number. Gives the started query."""

    def batch(rows: DataFrame, number: int) -> None:
        rules = policy.custom_types(rows.sparkSession.read.parquet(rules_path))
        write(pipeline.mask(rows, "payload", custom=rules), number)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _starry(text: str | None) -> bool:
    solid = [c for c in text or "" if not c.isspace()]
    return bool(solid) and sum(c == "*" for c in solid) >= 0.5 * len(solid)


def coalesced(requests: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Equal requests within the watermark's delay once."""
    return requests.withWatermark("at", delay).withColumn("h", F.sha2("payload", 256)).dropDuplicatesWithinWatermark(["payload_id", "h"]).drop("h")


def load(requests: DataFrame, value: str, length: str = "15 seconds", step: str = "1 second", delay: str = "1 minute") -> DataFrame:
    """Sliding sums of a cost."""
    return requests.withWatermark("at", delay).groupBy(F.window("at", length, step)).agg(F.sum(value).alias("total"))


def repeats(log: DataFrame, keys: list[str], length: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """The first of equal log rows in a span of time, with how many were suppressed."""
    return log.withWatermark("at", delay).groupBy(F.window("at", length), *keys).agg(F.min("at").alias("first_at"), (F.count("*") - 1).alias("suppressed"))

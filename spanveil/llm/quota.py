"""A sample with given shares of categories, a minimum from small ones, and a report of targets out of reach.

Method. Label counts are the only moments taken from the data, aggregated on the executors. The planned number of rows
is shared among the strata by exponential tilting: of all allocations between floors and what is there, the one nearest to
the target shares (by divergence). Newton iterations on the dual find the common multiplier; strata that reach a
bound stay there, so what a small stratum lacks, or gets above its share by its floor, is taken over by the free ones in
proportion to their targets. The sample is drawn with the resulting probabilities by the pivotal method: rows duel in
buckets of bounded size, and the at most one undecided row of each bucket and stratum goes on to a last round, so that
each stratum gets exactly its number of rows. Draws depend on a seed and the row id only, so a lost executor gives the
same sample again. The report names wanted and available rows of each stratum and the gap between target and drawn share.

Defined results: NULL and blank labels count as MISSING. Strata without a target are not sampled. Empty tables give
a report in which nothing is available. Rows that repeat an id are drawn as one row each, with the same chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.runtime import durable

MISSING = "без категории"
#: Rows of one bucket of the first round, about.
BUCKET_ROWS = 200_000
#: Strata a targets table may have: they are held by the driver and broadcast.
MAX_STRATA = 10_000
_TINY = 1e-9


def stratum_of(label: Column) -> Column:
    clean = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(MISSING)).otherwise(clean)


def tilt(shares: np.ndarray, low: np.ndarray, high: np.ndarray, size: float, tolerance: float = 1e-12, rounds: int = 200) -> np.ndarray:
    """Rows of each stratum, clip(share * exp(multiplier), low, high), that sum up to `size`: Newton iterations on the
    dual of exponential tilting, kept inside a bracket. If no multiplier reaches `size`, all strata are at a bound."""
    at = lambda m: np.clip(shares * np.exp(m), low, high)
    if not len(shares) or low.sum() >= size:
        return low.astype(float)
    if high[shares > 0].sum() + low[shares <= 0].sum() <= size:
        return np.where(shares > 0, high, low).astype(float)
    least, most = -60.0, 60.0
    mu = float(np.clip(np.log(size / shares.sum()), least, most))
    for _ in range(rounds):
        rows = at(mu)
        gap = rows.sum() - size
        if abs(gap) <= tolerance * size:
            break
        least, most = (least, mu) if gap > 0 else (mu, most)
        slope = rows[(rows > low) & (rows < high)].sum()
        step = mu - gap / slope if slope > 0 else least
        mu = step if least < step < most else (least + most) / 2
    return at(mu)


def whole(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whole numbers with the same rounded sum, the largest remainders rounded up, ties by place."""
    out = np.floor(rows + 1e-9)
    left = int(round(rows.sum() - out.sum()))
    order = sorted(range(len(rows)), key=lambda i: (out[i] - rows[i], i))
    for i in order:
        if left > 0 and out[i] + 1 <= high[i]:
            out[i] += 1
            left -= 1
    return np.clip(out, low, high).astype(int)


def plan(df: DataFrame, label: str, targets: list[tuple[str, int, int, int]]) -> list[dict]:
    """For (stratum, target_permille, min_rows, sample_permille): what is available, what is wanted (the larger of floor
    and share), how many rows are drawn, and with which probability a row of the stratum is drawn."""
    names = [t[0] for t in targets]
    if len(set(names)) != len(names) or len(names) > MAX_STRATA:
        raise ValueError("strata must be distinct and at most MAX_STRATA")
    s = stratum_of(F.col(label))
    counted = df.select(F.when(s.isin(names), s).alias("s")).groupBy("s").count().collect()  # at most MAX_STRATA + 1 rows
    have = {r["s"]: r["count"] for r in counted}
    total = sum(have.values())
    rows = [{"stratum": n, "permille": tp, "available": have.get(n, 0), "wanted": max(m, total * sp * tp // 1_000_000)} for n, tp, m, sp in targets]
    there = np.array([r["available"] for r in rows], float)
    floors = np.minimum([m for _, _, m, _ in targets], there)
    shares = np.array([total * sp * tp / 1_000_000 for _, tp, _, sp in targets], float)
    drawn = whole(tilt(shares, floors, there, float(np.floor(shares.sum()))), floors, there)
    for r, n in zip(rows, drawn.tolist()):
        r["rows"], r["p"] = n, min(1.0, n / r["available"]) if r["available"] else 0.0
    return rows


def _duels(ids, strata, chances, draws, end: bool):
    """Sequential pivotal rounds; one open row per stratum at a time. Gives (id, stratum, chance), chance being 1 or,
    for rows left open, what they go on with. At the `end`, open rows are settled: their chance is a whole number
    but for rounding."""
    open_rows: dict[str, tuple[int, float]] = {}
    for i, s, b, u in zip(ids, strata, chances, draws):
        if s not in open_rows:
            open_rows[s] = (i, b)
            continue
        j, a = open_rows.pop(s)
        both = a + b
        if both < 1 - _TINY:
            open_rows[s] = (j, both) if u * both < a else (i, both)
        else:
            first = u * (2 - both) < 1 - b
            yield (j if first else i), s, 1.0
            if both - 1 > _TINY:
                open_rows[s] = ((i if first else j), both - 1)
    for s, (i, a) in open_rows.items():
        if not end:
            yield i, s, a
        elif a > 0.5:
            yield i, s, 1.0


def draw(df: DataFrame, row_id: str, label: str, planned: list[dict], seed: int = 17) -> DataFrame:
    """row_id and stratum of the rows drawn."""
    kept = [r for r in planned if r["rows"]]
    if not kept:
        return df.select(F.col(row_id).alias("row_id"), stratum_of(F.col(label)).alias("stratum")).where(F.lit(False))
    spark = df.sparkSession
    p = F.broadcast(spark.createDataFrame([(r["stratum"], float(r["p"])) for r in kept], "stratum string, chance double"))
    rows = df.select(F.col(row_id).alias("row_id"), stratum_of(F.col(label)).alias("stratum")).join(p, "stratum")
    whole = rows.where("chance >= 1").select("row_id", "stratum")
    buckets = max(1, -(-sum(r["available"] for r in kept) // BUCKET_ROWS))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row_id").cast("string")), 11) / F.lit(float(1 << 53))).alias("u")
    part = rows.where("chance < 1").select("row_id", "stratum", "chance", u, F.pmod(F.xxhash64(F.lit(seed + 1), F.col("row_id").cast("string")), F.lit(buckets)).alias("bucket"))
    kind = part.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, stratum string, chance double"

    def rounds(end: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def stream():
                for b in batches:
                    yield from zip(b.row_id.tolist(), b.stratum.tolist(), b.chance.tolist(), b.u.tolist())

            out = []
            for row in _duels(*_unzip(stream()), end):
                out.append(row)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["row_id", "stratum", "chance"])
                    out = []
            yield pd.DataFrame(out, columns=["row_id", "stratum", "chance"]).astype({"chance": float})

        return run

    first = durable(part.repartition(buckets, "bucket").sortWithinPartitions("bucket", "u", "row_id").mapInPandas(rounds(False), schema))
    # At most one open row for each bucket and stratum comes here.
    rest = first.where("chance < 1").select("row_id", "stratum", "chance", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), F.col("row_id").cast("string")), 11).alias("v"))
    rest = rest.select("row_id", "stratum", "chance", (F.col("v") / F.lit(float(1 << 53))).alias("u"))
    last = rest.repartition(max(1, min(len(kept), buckets)), "stratum").sortWithinPartitions("stratum", "u", "row_id").mapInPandas(rounds(True), schema)
    return whole.unionByName(first.where("chance >= 1").select("row_id", "stratum")).unionByName(last.select("row_id", "stratum"))


def _unzip(rows):
    """Four lazy columns over one row stream, read in step by `zip`."""
    row: list = [None]

    def lead():
        for r in rows:
            row[0] = r
            yield r[0]

    def follow(k):
        while True:
            yield row[0][k]

    return lead(), follow(1), follow(2), follow(3)


def sample_by_target(df: DataFrame, row_id: str, label: str, targets: list[tuple[str, int, int, int]], seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample, report): the rows drawn (row_id, stratum), and for each target what was available, wanted, taken, and its
    target share and share of the sample in thousandths."""
    planned = plan(df, label, targets)
    sample = draw(df, row_id, label, planned, seed)
    spark = df.sparkSession
    all_rows, all_shares = max(1, sum(r["rows"] for r in planned)), max(1, sum(r["permille"] for r in planned))
    asked = spark.createDataFrame([(r["stratum"], r["available"], r["wanted"], 1000.0 * r["permille"] / all_shares) for r in planned], "stratum string, available long, wanted long, target_share double")
    taken = sample.groupBy("stratum").agg(F.count("*").alias("taken"))
    report = asked.join(F.broadcast(taken), "stratum", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return sample, report.withColumn("share", F.round(1000 * F.col("taken") / all_rows, 6)).select("stratum", "available", "wanted", "taken", "target_share", "share")

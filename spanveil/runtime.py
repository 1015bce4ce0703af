"""Session settings, durable intermediate results and skew-safe lookups shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts of several hundred KB exist, so a batch must stay small.
ARROW_ROWS = 512
#: Hot keys are those holding more than this share of all rows, so there are at most 1 / HOT_SHARE of them:
#: the proven bound of what `attach` broadcasts.
HOT_SHARE = 0.001


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the SQL options every plan of this package relies on; a smaller Arrow batch already set is kept."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # This rule puts the exploded expression into a filter as well, so that a detector would run twice for each text.
    rule = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"
    excluded = conf.get("spark.sql.optimizer.excludedRules", "") or ""
    if rule not in excluded:
        conf.set("spark.sql.optimizer.excludedRules", f"{excluded},{rule}".strip(","))
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share. The cluster names it in spark.checkpoint.dir; only where that is unset
    (tests on one machine) a temporary one is made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spanveil-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a reliable checkpoint in the shared folder, so that a lost executor costs no recompute
    and a result used twice is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, for work that costs far more than moving the rows once. A large table comes in more parts
    than there are cores and is left as it is."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder; `clean_scratch` removes what was given out."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Removes the folders that this session was given, and says how many. Call it when results built on them are read;
    checkpoints go by Spark's own cleaner (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def digest(*cols: Column) -> Column:
    """256-bit key of several columns; NULL and empty differ, and no two column splits agree."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in cols]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def attach(big: DataFrame, lookup: DataFrame, key: str, weight: str, keep_weight: bool = False) -> DataFrame:
    """Inner join of `big` with `lookup` (one row per key) where a key may hold a third of all rows of `big`.

    `lookup[weight]` says how many rows of `big` a key has. Keys above HOT_SHARE of the total go through a broadcast
    join: there are at most 1 / HOT_SHARE = 1000 of them whatever the input, which bounds the broadcast. The other
    keys are spread evenly enough for a plain shuffled join. No row is lost or capped.
    """
    total = lookup.agg(F.sum(weight).alias("t")).collect()[0]["t"] or 0
    floor = max(1000.0, total * HOT_SHARE)
    gone = () if keep_weight else (weight,)
    lookup_cold = lookup.where(F.col(weight) <= floor).drop(*gone)
    lookup_hot = lookup.where(F.col(weight) > floor).drop(*gone)
    if not lookup.where(F.col(weight) > floor).limit(1).collect():
        return big.join(lookup.drop(*gone), key)
    return big.join(F.broadcast(lookup_hot), key).unionByName(big.join(F.broadcast(lookup_hot.select(key)), key, "left_anti").join(lookup_cold, key))

"""SparkSession helpers.

The library never hard-codes a machine-local scratch folder: anything that
must survive executor loss (checkpoints, stand-in files for streaming demos)
goes below ``spark.checkpoint.dir``, which a cluster deployment points at a
shared file system.  Only when that setting is absent (local tests) do we
fill it in ourselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings every operator relies on.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Settings for scale: runtime re-planning, skew splitting, Arrow batches.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "netsleuth",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**RECOMMENDED_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings operators depend on to an existing session."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir``; sets one only when it is unset and the
    whole session runs on one machine (tests).  A cluster must name a folder
    that all its executors share.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (sessions without a local SparkContext)
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master if sc is not None else ""
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a checkpoint folder that all executors share")
        d = tempfile.mkdtemp(prefix="netsleuth-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system that its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def spread(df):
    """``df`` over as many partitions as the session has shuffle partitions, or
    cores if more: a small file of many rows is read by few tasks, which then
    hold all that they group."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def written(df, name: str):
    """``df`` written once as Parquet below the shared checkpoint folder and
    read back: for long tables that are read several times, much smaller than a
    checkpoint and read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df, eager: bool = True):
    """Cut the lineage of ``df`` with a reliable checkpoint written below
    ``spark.checkpoint.dir`` (shared storage on a cluster, so the result
    survives executor loss).  Used where a result is read several times
    downstream: mostly tables much smaller than their input, but also the ranked
    rows and the feature table in training, which are as long as the events."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)

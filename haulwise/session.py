"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that every job relies on. Skewed join partitions are split
# by AQE even where the split costs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # shuffled rows go when the query that moved them ends, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


# Most bytes of a file or of shuffled rows that a task gets: its sort buffers and hash tables
# then stay the same size while the input grows. A smaller value set by the job stands.
MOST_BYTES = {
    "spark.sql.files.maxPartitionBytes": 32 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
}


# A setting of the job: tasks to deal documents out to before they are cut into chunks.
SPREAD = "spark.haulwise.spread"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, most in MOST_BYTES.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")
    return spark


def deal_finer(spark: SparkSession) -> SparkSession:
    """Start shuffles with up to eight times the job's partitions (200 at most, if it has fewer): AQE merges
    small ones by size, but cannot split large ones before an aggregate."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(parts, min(200, 8 * parts)))
    return spark


def _bytes(size: str) -> int:
    """Bytes of a size as Spark's settings give it: 64MB, 16m, 1024b or a plain number."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index((unit or "b")[0])


def build_session(app: str = "haulwise", master: str | None = None, **conf) -> SparkSession:
    """A session with the runtime settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder, because there driver and executors are
    one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="haulwise-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder; unlike a checkpoint it tells Catalyst its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably and forget the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out for heavy row work, to as many tasks as the job asks for in ``SPREAD``.

    Useful where a whole input is one small file and so one scan task; unset, the
    input stays as it is, without a shuffle.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df

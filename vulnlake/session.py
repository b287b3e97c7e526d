"""Spark session set-up shared by the library, tests and the bench.

Everything here is plain Spark configuration.  The session time zone is UTC
because weekday / hour / month buckets depend on it (ledger L12), AQE is on so
that small join sides are broadcast from *runtime* statistics and skewed
partitions are split, and ANSI mode stays on (dirty data goes through
``try_*`` functions instead).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce small shuffle partitions to the advisory size (64 MB), not to max parallelism
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vulnlake", extra: dict | None = None) -> SparkSession:
    """Return a session with the library's defaults applied.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a cluster
    the launcher sets them and this function leaves them alone.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime (SQL) settings to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


#: Bytes of an Arrow batch that is sent to a Python task; by default only its 10,000 rows bound it.
BATCH_BYTES = 2 << 20


def small_batch_bytes(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of at most about ``most`` bytes for this session, unless it asks for fewer."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark.conf.get(key).removesuffix("b")
    if not asked.isdigit() or int(asked) > most:
        spark.conf.set(key, str(most))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) do we choose a fresh scratch folder ourselves.  Works on a
    classic session and, through the session conf, on Spark Connect."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    d = None
    if sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001
            d = None
    if not d:
        if sc is not None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # local runs (tests) only: a fresh scratch folder
        d = tempfile.mkdtemp(prefix="vulnlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local one
    on a cluster), for jobs that write and read back intermediate tables."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/vulnlake-{name}-{uuid.uuid4().hex[:12]}"

"""Session helpers: sane defaults for local tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tagseries", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="tagseries-ckpt-")
    if "spark.sql.warehouse.dir" not in conf:
        conf["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="tagseries-wh-")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The configured shared folder; a folder of its own only on a local master."""
    d = ensure_checkpoint_dir(spark, allow_local=spark.sparkContext.master.startswith("local"))
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return d


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str | None:
    """Point the context at ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is simply honoured.  Only
    when it is unset *and* ``allow_local`` is given (tests, local bench) a fresh
    scratch folder is created.  Returns the directory in use, or ``None``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not allow_local:
            return None
        d = tempfile.mkdtemp(prefix="tagseries-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d

"""Session helpers.

Library functions never create a session; they take DataFrames.  These helpers
are for entry points, tests and the bench script.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  ANSI mode stays on (Spark 4
# default); the expressions are written for it (try_* casts where needed).
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a bloom filter of the small side (e.g. the winning candidate URLs)
    # prunes the big side (the crawl snapshot with bodies) before its shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # contents are large: keep Arrow batches small for the pandas steps
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # RDD checkpoint files are removed once unreferenced; stage tables by remove_stages()
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mdweave") -> SparkSession:
    """Create (or reuse) a session with the package's defaults.

    On a cluster ``master`` is left to spark-submit; locally pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("MDWEAVE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``;
    it is read from the session and never replaced.  Only when it is unset (local
    tests) a scratch directory is created.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="mdweave-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder name (not created) beside the stage tables of this application; ``remove_stages`` removes it."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/mdweave-stages/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession) -> str:
    """A new catalog name for a table under a ``scratch_folder`` (only tables keep buckets); ``remove_stages`` drops it."""
    import uuid
    return f"{_table_prefix(spark)}{uuid.uuid4().hex}"


def _table_prefix(spark: SparkSession) -> str:
    return "mdweave_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId).lower() + "_"


def remove_stages(spark: SparkSession) -> bool:
    """Delete the stage tables, scratch folders and scratch tables of this application, and
    say whether there were any.  For the end of a run, once its results are
    written: DataFrames that still read stage tables can't be used afterwards."""
    for row in spark.sql(f"SHOW TABLES LIKE '{_table_prefix(spark)}*'").collect():
        spark.sql(f"DROP TABLE IF EXISTS `{row.tableName}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{ensure_checkpoint_dir(spark).rstrip('/')}/mdweave-stages/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, how: str | None = None):
    """Materialise a stage output that several later steps read.

    ``table`` (default) writes the rows as parquet under the shared checkpoint
    directory (``spark.checkpoint.dir``) and reads them back: one computation,
    columnar compressed storage, lineage cut (small plans, no recomputation of
    upstream stages after an executor loss) and real size statistics for AQE
    and broadcast decisions.  ``checkpoint`` uses ``Dataset.checkpoint`` in the
    same directory; ``cache`` persists in executor memory/disk; ``none``
    leaves the plan lazy.  Chosen per session with ``mdweave.materialize``.
    """
    import time
    import uuid

    from pyspark import StorageLevel

    spark = df.sparkSession
    how = how or spark.conf.get("mdweave.materialize", "table")
    t = time.time()
    if how == "table":
        base = ensure_checkpoint_dir(spark).rstrip("/")
        path = f"{base}/mdweave-stages/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        out = spark.read.parquet(path)
    elif how == "checkpoint":
        ensure_checkpoint_dir(spark)
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist(blocking=False)
    elif how == "cache":
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        out = df
    if os.environ.get("MDWEAVE_TIMING"):
        import traceback
        caller = traceback.extract_stack(limit=3)[0]
        print(f"[materialize] {caller.name}:{caller.lineno} {time.time() - t:.2f}s", flush=True)
    return out

"""Session helpers.

``configure`` sets the SQL options the operators rely on. It only touches
session-level SQL confs, so it is safe to call on a session someone else
built (the driver's, a notebook's, a cluster's).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Options every operator assumes. Duplicate JSON keys keep the last value,
# like Python's json.loads; UTC so timestamps compare across
# engines; AQE for runtime coalescing and skew-join splitting.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tuneval`` importable in executor Python workers.

    The three Arrow UDFs are pickled by reference to their module, so the
    workers need the package. It is zipped once per application and added
    with ``addPyFile`` (distributed by Spark itself, like ``--py-files``).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    zp = os.path.join(tempfile.mkdtemp(prefix="tuneval-pkg-"), "tuneval.zip")
    with zipfile.ZipFile(zp, "w") as z:
        for dp, _, fs in os.walk(pkg):
            for f in fs:
                if f.endswith(".py"):
                    full = os.path.join(dp, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zp)
    _SHIPPED.add(key)


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def get_session(master: str | None = None, app: str = "tuneval",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Builder used by tests, bench and examples (never by the operators)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.driver.memory", os.environ.get("TUNEVAL_DRIVER_MEM", "8g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediates.

    Reads the cluster's ``spark.checkpoint.dir``. Only a local session without
    one gets a temporary folder; on a cluster that would be another folder on
    every machine, so it is an error there.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tuneval-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def _scratch_root(spark: SparkSession) -> str:
    return checkpoint_dir(spark).rstrip("/") + f"/tables/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster: it lives wherever ``spark.checkpoint.dir`` points)."""
    import uuid
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Lineage cut as a Parquet table in the shared folder. Unlike after a
    checkpoint the planner knows the table's size, so it broadcasts small
    ones by the session's threshold and no others."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete the scratch tables of this application. To be called when the
    results that were built on them have been written."""
    jvm, root = spark._jvm, _scratch_root(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

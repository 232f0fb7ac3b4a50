"""Session helpers: a tuned local session for tests/bench, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
}


def get_session(cpus: int | None = None, app: str = "tracesift", conf: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster the caller brings its own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = dict(_DEFAULTS)
    settings["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or the context's checkpoint
    dir). Only when neither is set and the master is local (tests) is a temporary folder
    created and registered, so that ``DataFrame.checkpoint()`` works too; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tracesift-ckpt-")  # one machine (tests, bench)
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # noqa: BLE001 - core settings may be read-only at runtime
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name or 'tmp'}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_dir(spark)


def stored(df, name: str = "stored"):
    """``df`` written once as a table in the shared checkpoint folder, and read back: lineage ends there.

    Partitioning and row order are not kept; where they matter, see ``fresh_checkpoint``.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_checkpoint(df):
    """Reliable ``checkpoint()`` whose columns get fresh attribute ids.

    A checkpoint reuses the attribute ids of the plan it was taken from; joining
    or set-combining the result with its own source would put two different
    relations under the same ids. Re-aliasing every column first avoids that.
    The input is cached while it is written: a reliable checkpoint otherwise
    computes its input twice (once to count, once to write the files).
    """
    from pyspark import StorageLevel
    from pyspark.sql import functions as F

    ensure_checkpoint_dir(df.sparkSession)
    staged = df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return staged.checkpoint()
    finally:
        staged.unpersist()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tracesift`` importable in executor Python workers (pandas UDFs, applyInPandas, mapInPandas).

    The package is zipped once per process and registered with
    ``SparkContext.addPyFile``, the same mechanism as ``--py-files``; Spark
    copies it to every executor. A package already importable on the executors
    (installed in the image) makes this a no-op in effect.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tracesift-pyfiles-"), "tracesift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith((".py", ".sql")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)

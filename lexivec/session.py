"""Session helpers: a local session for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lexivec") -> SparkSession:
    """A local session configured like the cluster one (AQE on, UTC, Arrow, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXIVEC_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Settings every plan in this package relies on for reproducible results, and the package
    itself on every executor's Python path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    work_dir(spark)
    ship_package(spark)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Ship this package to the executors' Python workers (what ``--py-files`` does), once per
    context. The archive is built on the driver and distributed by Spark itself."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="lexivec-pyfiles-"), "lexivec.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, index versions and stream state.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Without either, a local
    master gets a temporary folder; on a cluster that is an error, since executors would each
    write to their own disk.
    """
    sc = spark.sparkContext
    d = None
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf not settable/readable
        d = None
    if not d:
        try:
            d = sc.getCheckpointDir()
        except Exception:  # pragma: no cover
            d = None
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lexivec-ckpt-")
        sc.setCheckpointDir(d)
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # pragma: no cover - static conf in some deployments
            pass
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def store_once(df, name: str):
    """Write ``df`` to the shared folder and return the stored rows: what several branches read is
    computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_root(spark: SparkSession) -> str:
    """The one folder that holds all scratch tables of this application."""
    return f"{work_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the application's scratch folder in the shared work folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables, for its end or between jobs: results that were not
    written elsewhere can no longer be read afterwards. Stored indexes stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Spark session helpers.

Cluster settings (checkpoint dir, shuffle partitions, memory) come from the
submitting environment; these helpers only fill in what is unset, which is the
case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import PySparkAttributeError, PySparkNotImplementedError
from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "tomefold") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir; create a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    """
    sc = _context(spark)
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="tomefold-ckpt-", dir=os.environ.get("TOMEFOLD_SCRATCH", "/tmp"))
    if sc:
        sc.setCheckpointDir(scratch)
    else:
        spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except (PySparkAttributeError, PySparkNotImplementedError):  # what a Connect session raises
        return None


def written(df, name: str):
    """``df`` written once as Parquet under the checkpoint dir and read back.

    What several branches read is then computed once, on shared storage: a lost executor
    loses nothing, and later scans prune columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tomefold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tomefold`` importable in Python workers (UDFs pickle references to it).

    Adds the package as a zip with ``addPyFile`` (shipped to every executor) and
    puts its parent directory on the workers' PYTHONPATH for local runs.
    Idempotent per SparkContext.
    """
    import zipfile

    sc = _context(spark)
    if sc is None:  # Spark Connect: code is shipped with the client's artifacts
        return
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg)
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if parent not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([parent] + paths)
    out_dir = tempfile.mkdtemp(prefix="tomefold-code-")
    zpath = os.path.join(out_dir, "tomefold.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def keep_cached(result, *persisted):
    """Remember the frames persisted to build ``result`` (see ``release``)."""
    result._tomefold_persisted = list(getattr(result, "_tomefold_persisted", [])) + list(persisted)
    return result


def release(*results) -> None:
    """Unpersist what was cached to build ``results`` (call after they were written)."""
    for result in results:
        for df in getattr(result, "_tomefold_persisted", []):
            df.unpersist()

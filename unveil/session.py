"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: keep Arrow batches bounded (10,000 records of up to 128K chars is too much)
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's session."""
    b = SparkSession.builder.master(master).appName("unveil")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULT_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and it is used as is. When it is
    unset, a private folder is created on a local master (one JVM, tests); on
    any other master that is an error, because executors could not see it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="unveil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared work folder for one job's tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``unveil`` importable in local-mode Python workers (once per app).

    The Arrow UDFs and ``mapInPandas`` functions live in this package. In
    local mode (tests, bench, driver checks) the package is zipped and handed
    to ``addPyFile``; cluster deployments pass it with ``--py-files``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if not sc.master.startswith("local"):
        # On a cluster the package is deployed the standard way
        # (--py-files / spark.submit.pyFiles); nothing is staged locally.
        _SHIPPED.add(app)
        return
    import shutil

    pkg_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tempfile.mkdtemp(prefix="unveil-pyfiles-")
    archive = shutil.make_archive(
        os.path.join(out, "unveil"), "zip", root_dir=pkg_root, base_dir="unveil"
    )
    sc.addPyFile(archive)
    _SHIPPED.add(app)

"""Session helpers: one place for the settings every stage relies on.

Nothing here is required when a cluster already provides a session; the
helpers only fill in settings that are unset, so a cluster's own choices
(shuffle partitions, checkpoint directory, time zone) always win.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the library depends on for correct results, not for speed.
_REQUIRED = {
    # Timestamps are stored and compared in UTC (ISO-8601, UTC convention).
    "spark.sql.session.timeZone": "UTC",
}

# Settings that help at scale; applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(
    app: str = "strata",
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    driver_memory: str = "8g",
) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**_DEFAULTS, **_REQUIRED}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply required settings and fill unset defaults on an existing session."""
    for k, v in _REQUIRED.items():
        spark.conf.set(k, v)
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is
    used as is; a cluster that names none is an error, as executors could
    not see a folder of the driver's. In local mode (tests, a laptop) a
    temporary folder is created and set.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="strata-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - a session may refuse core settings at runtime
            pass
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return str(current)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per context), so Python
    tasks can import it wherever the driver was started from."""
    sc = _context(spark)
    if sc is None or getattr(sc, "_strata_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    digest = hashlib.sha1(held.getvalue()).hexdigest()[:12]
    local = os.path.join(tempfile.mkdtemp(prefix="strata-ship-"), f"strata-{digest}.zip")
    with open(local, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(local)  # Spark copies it to every executor
    sc._strata_shipped = True


def _context(spark: SparkSession):  # noqa: ANN202
    """The SparkContext when the session has one (not under Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001
        return None


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint directory.

    Used for intermediate tables written to cut lineage and for files the
    driver queries stage before reading them back. Never machine-local on
    a cluster, because the root is the cluster's shared checkpoint folder.
    """
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root.rstrip("/"), "strata-scratch", f"{name}-{uuid.uuid4().hex[:12]}")
    return path


def size_for_input(
    spark: SparkSession,
    input_bytes: int,
    *,
    target_partition_mb: int = 256,
    max_split_mb: int = 256,
    min_partitions: int = 200,
) -> int:
    """Size shuffles and scan splits for an input of ``input_bytes``.

    Sets ``spark.sql.shuffle.partitions`` to about one partition per
    ``target_partition_mb`` of input (AQE then coalesces small ones and
    splits skewed ones), the AQE advisory size to the same target, and
    the scan split size, so a task's share fits executor memory without
    spilling at 100 TB as at 100 GB. Returns the partition count.
    """
    target = target_partition_mb * 1024 * 1024
    parts = max(min_partitions, -(-int(input_bytes) // target))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_split_mb * 1024 * 1024))
    return parts

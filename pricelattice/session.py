"""The session that tests, the bench and local work use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, where no PYTHONPATH tells them of it."""
    sc = spark.sparkContext
    if getattr(sc, "_has_package", False) or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    package = Path(tempfile.mkdtemp(prefix="spark-")) / f"{__package__}.zip"
    with zipfile.ZipFile(package, "w") as z:
        for f in sorted((ROOT / __package__).rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(package))
    sc._has_package = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches.

    Where the session has no such setting, the context's checkpoint folder serves; where it has none either, a temporary one is set on
    a local master only: on a cluster executors would not share it, so that raises.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def get_session(app: str = "pricelattice", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC dates and adaptive execution; on a cluster, bring your own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark

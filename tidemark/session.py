"""Sessions: the settings the jobs expect, and the package on every Python worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session. On a cluster the caller's own session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-tidemark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Gives Python workers the package, once for each Spark context, unless they find it on PYTHONPATH."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_tidemark_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="spark-tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._tidemark_shipped = True
    return spark

"""Sessions and the package's delivery to executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch: whole texts are long, and a worker holds a batch and what it makes of it.
ARROW_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def local_session(cpus: str = "*", name: str = "placespark", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that its Arrow functions can be imported there.

    Spark's default bound on the bytes of an Arrow batch is lowered for the session; one that is set already stays.
    """
    if spark.conf.get(ARROW_BYTES) in ("64MB", "67108864b"):
        spark.conf.set(ARROW_BYTES, f"{BATCH}b")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="spark-")
        shutil.copytree(root, f"{folder}/package/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", f"{folder}/package"))
        _shipped.add(app)
    return spark

"""Session defaults shared by tests, bench and entry points."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[4]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; further settings by keyword (dots written as ``__``)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("stepfree")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this repository's Python modules to the workers, once for each application.

    Functions that run in tasks are imported there by name; where the repository is
    installed on every machine this changes nothing.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="stepfree-")) / "stepfree_modules.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in [*root.glob("stepfree/**/*.py"), *root.glob("corpus_pipeline.py")]:
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)

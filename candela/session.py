"""A session with the settings that the engine is written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "candela", master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one. Names of settings have _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package: from where the driver has it on this machine, and on others from an archive that Spark hands out."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(root), *filter(None, paths)])
    if not sc.master.startswith("local") and not getattr(sc, "_candela", None):
        # addPyFile() serves the driver's copy to executors; nothing of it needs to be shared.
        sc._candela = Path(tempfile.mkdtemp(prefix="candela-")) / "candela.zip"
        with zipfile.ZipFile(sc._candela, "w") as z:
            for f in sorted((root / "candela").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(sc._candela))

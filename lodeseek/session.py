"""Sends this package to the Python workers of executors that don't have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once per application: adds the package, zipped, to the workers' Python path."""
    if (app := spark.sparkContext.applicationId) not in _sent:
        d = tempfile.mkdtemp(prefix="lodeseek-package-")  # the driver serves the file from there while it lives
        atexit.register(shutil.rmtree, d, True)
        with zipfile.ZipFile(path := os.path.join(d, "lodeseek_package.zip"), "w") as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f.relative_to(ROOT.parent))
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark

"""Makes this package importable for Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    _SHIPPED.add(sc)
    here = Path(__file__).resolve().parent
    file = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{here.name}.zip")
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    sc.addPyFile(file)

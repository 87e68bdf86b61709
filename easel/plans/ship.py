"""Give the package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_TOP = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Add this package to the job's Python files, once for each SparkContext.

    Workers import functions by name, so they need the package also where only the driver has it on its path.
    """
    context = spark.sparkContext
    if getattr(context, "_easel_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="easel-ship-")) / "easel.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_TOP.rglob("*.py")):
            z.write(p, p.relative_to(_TOP.parent))
    context.addPyFile(str(path))
    context._easel_shipped = True

"""Makes the package importable in Spark's Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application once; the driver serves it to the workers."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="sitefold-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json", ".dat") and "__pycache__" not in p.parts:
                z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(f.name)
    _shipped.add(sc.applicationId)

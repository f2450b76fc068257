"""Making the package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the session's executors, once per application.

    Needed where it is not installed on every node; workers started elsewhere
    than in the repository would not find it otherwise.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="weftlog-")) / "weftlog.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)

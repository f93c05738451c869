"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_tessela_shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once per context: the
    driver serves them, so workers need neither a shared folder nor a search path."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    target = Path(tempfile.mkdtemp(prefix="tessela-")) / "tessela_sources.zip"
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))
    setattr(sc, _MARK, True)

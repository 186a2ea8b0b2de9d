"""Tallystone: source-code and corpus analytics on PySpark DataFrames."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

__version__ = "0.1.0"

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors of a session, once, so that Python workers find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="tallystone-") as folder:
        copy = Path(folder, "package", home.name)
        shutil.copytree(home, copy, ignore=shutil.ignore_patterns("__pycache__"))
        # the name is new in every session: Spark keeps files by name
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="tallystone-"), f"tallystone-{context.applicationId}")), "zip", copy.parent)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application.

    Needed by the parts that run Python in tasks, unless the package is
    installed on the executors or was given with ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # already runs from a shipped archive
        return
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="contentdup-"), "contentdup"), "zip", os.path.dirname(here), "contentdup"
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

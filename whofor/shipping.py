"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Add the package to the job's Python files, as ``--py-files`` would."""
    here = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    base = os.path.join(out, "whofor")
    shutil.copytree(here, os.path.join(out, "src", "whofor"),
                    ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.join(out, "src")))

"""Getting this package to the tasks of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def archive(path: str) -> str:
    """A zip of the package's modules, at path."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(HERE)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(HERE), os.path.relpath(full, HERE)))
    return path


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed; once for a session.

    A local session's workers get the folder it lies in on their path. On a cluster that folder isn't there, so Spark
    sends the package to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        root, env = os.path.dirname(HERE), sc.environment
        if root not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    else:
        sc.addPyFile(archive(os.path.join(tempfile.mkdtemp(prefix="strandline-"), "strandline.zip")))
    sc._strandline_shipped = True

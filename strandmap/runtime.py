"""What a session needs before Python workers can run this library's functions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Sends the library to the executors, once a context, so that workers can import it wherever it lies on the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_strandmap_shipped", False) or not os.path.isdir(PACKAGE):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="strandmap-"), "strandmap-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("strandmap", os.path.relpath(full, PACKAGE)))
    sc.addPyFile(path)
    sc._strandmap_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a session within one JVM may have none named."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="strandmap-")
    return f"{at.rstrip('/')}/strandmap/{name}-{uuid.uuid4().hex[:12]}"

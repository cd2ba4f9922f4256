"""The package on the workers of a cluster."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SHIPPED: set[str] = set()
PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Sends this package to every worker of the application, once; Python steps import it there.

    Spark itself copies the archive to the workers, so it does not matter where the driver was started.
    """
    application = spark.sparkContext.applicationId
    if application in SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="txnguard-ship-"), "txnguard.zip")
    with open(path, "wb") as out:
        out.write(archive())
    spark.sparkContext.addPyFile(path)
    SHIPPED.add(application)


def archive() -> bytes:
    """The package's source files as a zip archive that Python can import from."""
    data, top = io.BytesIO(), os.path.dirname(PACKAGE)
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, top))
    return data.getvalue()

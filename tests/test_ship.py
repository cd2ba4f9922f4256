"""The package reaches the workers from whatever folder the driver was started in."""

import importlib.util
import io
import os
import subprocess
import sys
import zipfile
from pathlib import Path

from txnguard import ship

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import importlib.util, sys
from pyspark.sql import SparkSession
sys.path.insert(0, {repo!r})
spark = (SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "2")
    .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp}/shared").config("spark.sql.session.timeZone", "UTC").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as e
print("ROWS", e.queries()["score_linear"](spark, {sf!r}).count(), e.queries()["minority_knn"](spark, {sf!r}).count())
"""


def test_archive_holds_the_sources():
    names = zipfile.ZipFile(io.BytesIO(ship.archive())).namelist()
    assert "txnguard/__init__.py" in names and "txnguard/operators/patterns.py" in names
    assert all(n.startswith("txnguard/") and n.endswith(".py") for n in names)


def spark_home(folder):
    """Spark's home with links to its parts: a local cluster's workers keep their files in ``work`` there and end the JVM
    if they can't write to it, as in an installation that belongs to somebody else."""
    folder.mkdir()
    for part in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if part.name != "work":
            (folder / part.name).symlink_to(part)
    return str(folder)


def test_workers_find_the_package(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env |= {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    env |= {"SPARK_HOME": spark_home(tmp_path / "home"), "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    code = PROGRAM.format(repo=REPO, tmp=tmp_path, sf=sf_dir)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 500 280" in done.stdout, "\n".join((done.stdout[-500:], done.stderr[:3000], "...", done.stderr[-2000:]))

"""Session helpers: where intermediate tables go, and sizes read from the plan."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent on one machine (tests) a temporary folder of
    this process takes its place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quorumlake-"))
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    the written table outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more: what was made of
    them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python finds it already
    (it is on PYTHONPATH or in the working folder)."""
    root = Path(__file__).resolve().parent.parent
    seen = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    app = spark.sparkContext.applicationId
    if root in seen or app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="quorumlake-")  # served from here as long as the session lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    pack = Path(folder, "quorumlake-package.zip")
    with zipfile.ZipFile(pack, "w") as z:
        for f in sorted((root / "quorumlake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(pack))
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()

"""Working on a cluster: code for the executors, a folder that all of them share, tables written to cut lineage."""

from __future__ import annotations

import atexit
import itertools
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a table whose size is known.
FILE_ROWS = 50_000
PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_numbers = itertools.count()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    at = Path(tempfile.mkdtemp(prefix="attestry-code-"))
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    with zipfile.ZipFile(at / "attestry_code.zip", "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(str(at / "attestry_code.zip"))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; a local one only in local mode where that is unset.

    On a cluster without that setting this refuses: executors don't see each other's disks.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="attestry-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            base = f"file://{base}"
        _own_dirs[app] = f"{base.rstrip('/')}/attestry-{uuid.uuid4().hex}"
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{next(_numbers)}"


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df of at most `rows` rows, the result of a shuffle, in a number of partitions that befits it.

    Adaptive execution sees to that by itself. Where it may not, few rows go through one more shuffle, to as many
    partitions as there are cores, or as hold FILE_ROWS each: a task that took over several partitions of the plan
    would hold the memory of all their sorts until it ends.
    """
    spark = df.sparkSession
    adaptive = all(spark.conf.get(f"spark.sql.adaptive.{x}enabled") == "true" for x in ("", "coalescePartitions."))
    n = max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return df if adaptive or int(spark.conf.get("spark.sql.shuffle.partitions")) <= 2 * n else df.repartition(n)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, and lost executors lose nothing.

    rows: that there are at most, where that is known; few rows then go to few files.
    """
    path = new_path(df.sparkSession, name)
    (df if rows is None else gathered(df, rows)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_shared(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when its results have been stored."""
    path = _own_dirs.pop(spark.sparkContext.applicationId, None)
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

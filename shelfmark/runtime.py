"""Session-level helpers: table access and staged tables in the shared folder.

A long job cuts its lineage by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``.  All executors share that folder, so a lost executor costs only the
tasks it was running.  Where the setting is missing (tests on one machine) a temporary folder
is made for the session.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_DIRS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; ``<name>.parquet`` may be a file or a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, else a local one in local mode.

    Raises ValueError on a cluster whose session names no shared folder, because a
    machine-local folder would not be seen by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a staged table."""
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    The plan before the call runs exactly once; later users prune and filter the Parquet copy.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CACHED: dict[tuple[str, str], tuple[str, StructType]] = {}


def table_state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: equal as long as the table is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    told = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.blake2b(repr(told).encode(), digest_size=8).hexdigest()


def cached(spark: SparkSession, label: str, state: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that is staged once in an application, and anew when ``state`` of what it comes from changes."""
    key = (spark.sparkContext.applicationId, f"{label}-{state}")
    if key in _CACHED:
        path, schema = _CACHED[key]
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return spark.read.schema(schema).parquet(path)
    df, path = make(), new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    _CACHED[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that no plan reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove all staged tables of this application; results that read them must have been written before."""
    discard(spark, f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application.

    Python workers of a cluster do not see the driver's import path.
    """
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="shelfmark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "shelfmark_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)

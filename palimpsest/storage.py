"""Where intermediate tables go: the folder that all executors share.

Lineage is cut by writing a table there and reading it back, so any executor may be lost at any
time. The folder is the session's ``spark.checkpoint.dir``; only where that is unset, and the
master is local, a temporary folder of this machine is used and removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URL, without a slash at its end."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        ready = sc._jsc.sc().getCheckpointDir()
        found = ready.get() if ready.isDefined() else None
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return "file://" + _local["dir"]


#: Folders written and not yet removed, by application: lazy results read some of them.
_made: dict[str, set[str]] = {}


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to a new folder of the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the folder that ``written`` made, once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    files = df._jdf.inputFiles()
    if len(files):
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        _delete(spark, folder)


def _delete(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    name = folder.getName()
    made = _made.get(spark.sparkContext.applicationId, set())
    made -= {p for p in made if p.rsplit("/", 1)[-1] == name}


def clean(spark: SparkSession) -> int:
    """Deletes all intermediate tables of this application, once no result that reads them is needed any more. How many."""
    left = list(_made.get(spark.sparkContext.applicationId, ()))
    for path in left:
        _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return len(left)


def spread(df: DataFrame) -> DataFrame:
    """``df``, read from fewer files than there are cores, dealt out to all of them; any other as it is.

    A small file is one task however much work its rows are. Where files are many this does nothing.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # counted where they are: there may be very many
    return df.repartition(n) if 0 < files < n else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the Python workers of every executor import this package, once per application."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="palimpsest-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/palimpsest.zip", "w") as z:
        for at, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(f"{folder}/palimpsest.zip")
    _shipped.add(sc.applicationId)

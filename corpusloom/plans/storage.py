"""Tables written on the way, in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session; where that is unset (tests, one machine) a temporary folder is made
once per application and set as the session's own. A written table cuts the lineage and survives the loss of executors.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables written on the way, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables written on the way."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, unless they find it where it lies: on PYTHONPATH or in the working folder."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if any(p and Path(p).resolve() == root for p in known) or f"code-{app}" in _LOCAL:
        return
    folder = tempfile.mkdtemp(prefix="corpusloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/corpusloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.glob("corpusloom/**/*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)  # Spark copies it to every executor
    _LOCAL[f"code-{app}"] = path


def materialize(df: DataFrame, name: str = "table", partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the same rows, with no lineage.

    An empty table comes back empty with the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written on the way, once what was made of them is stored; how many there were. DataFrames that read them can't be used any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hconf).delete(p, True)
    return len(paths)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that ``materialize`` returned."""
    spark = df.sparkSession
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(hconf).getFileStatus(p).getLen()
    return total

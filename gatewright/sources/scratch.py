"""Tables that cut the lineage of iterations, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written under spark.checkpoint.dir and read back. Where that is unset, a single local JVM gets a temporary
    folder, which goes when Python ends; on a cluster it is an error."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="gatewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = "file://" + folder
        base = _own[app]
    path = f"{base.rstrip('/')}/gatewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more, and has Spark drop the shuffle files of plans that are gone."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()

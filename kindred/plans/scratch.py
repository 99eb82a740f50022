"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset on a local master, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kindred-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; later readers of it survive lost executors. It stays until `discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made. Nothing that is read later may stand on them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kindred_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

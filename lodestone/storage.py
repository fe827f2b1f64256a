"""Tables that cut lineage: written once to the folder that driver and executors share, and deleted when they have served."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder if the session is local (as in tests); on a
    cluster executors would write to their own disks, so that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        master = context.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(found)
    return found


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; a lost executor leads to a read, not to a new run."""
    path = f"{_base(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise returned. Only once all that reads them has itself been written: a stage that is run
    again after a loss reads its input again."""
    for table in tables:
        _delete(table.sparkSession, table.lodestone_path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this session has materialised. Results that read it are gone, too."""
    _delete(spark, _base(spark))

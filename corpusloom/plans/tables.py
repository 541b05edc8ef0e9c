"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's own; a temporary folder only where neither is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0]
    import tempfile

    return f"file://{tempfile.gettempdir()}/checkpoints"


def run_folder(spark: SparkSession) -> str:
    """The application's own folder; it is deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    at = f"{shared_dir(spark)}/stored-{app}"
    if _folders.get(app) != at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[app] = at
    return at


def stored(df: DataFrame) -> DataFrame:
    """Write and read back: cuts the lineage of iterations and survives lost executors."""
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting lineage on storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark removes the shuffle files of a query once it has run.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files; each runs once, as its rows are kept elsewhere or used up.

    Else these files stay until the driver happens to collect its garbage, which long chains of small jobs don't bring about.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; fall back to a local folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scholia-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the reliable checkpoint folder, so that a lost executor costs no rows."""
    ensure_checkpoint_dir(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``durable``, but as a Parquet table in the shared folder: smaller for wide rows, and read with pruning."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    with freeing(spark):
        df.select("*").write.parquet(path)
    return spark.read.parquet(path)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"


def dropped(df: DataFrame) -> None:
    """Remove the table behind what ``written`` returned, once nothing will read it again."""
    spark = df.sparkSession
    base = f"{spark.sparkContext.getCheckpointDir()}/tables/"
    for folder in {f[: f.rindex("/")] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Session helpers: table access, lineage cuts and shuffle sizing."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting for deleting the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent, and only in local mode, a temporary folder is chosen here and removed at the end.
    A cluster has to name a shared folder, since a machine-local one cannot be read by other executors.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kinweave-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and go on from there.

    Unlike ``checkpoint()`` this computes the rows once, keeps them columnar, gives the planner their true size and
    carries no accumulated constraints into the next round of an iteration.  It survives the loss of executors.
    Shuffle files of the writing are deleted as it ends; nothing reads them again, and the driver's collection of garbage
    leaves those of the last statement.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.rpartition("/")[2].startswith("cut-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now instead of at the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for explicit range partitioning: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

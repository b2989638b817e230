"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracelode")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, for clusters whose nodes don't have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tracelode-")
    path = os.path.join(folder, "tracelode_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; without it, only a local session gets a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracelode-checkpoints-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


_scratch: dict[str, SparkSession] = {}


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, for a table that an operator writes and reads again."""
    root = os.path.join(shared_dir(spark), f"tracelode-{spark.sparkContext.applicationId}")
    if root not in _scratch:
        _scratch[root] = spark
        atexit.register(drop_scratch, spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application's operators wrote for themselves; results that were not read yet go with them."""
    for root in [r for r, s in _scratch.items() if s is spark]:
        del _scratch[root]
        try:
            fs, where = file_system(spark, root)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended: its shared folder is left to whoever set it
            pass


def stored(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back: for what is read twice and must be the same both times.

    With `partition`, a column of few values, each value has a folder of its own and is read alone.
    """
    path = scratch_table(df.sparkSession, name)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """`df` in enough partitions to keep all cores busy with costly Python work; as it is where it has them.

    Only an input of fewer partitions than cores is moved, so what is shuffled is bounded by the cores times a split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores * tasks_per_core)

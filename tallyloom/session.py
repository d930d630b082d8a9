"""Session helpers: shared folder, materialised intermediates, shuffle width."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests), a temporary
    folder is made once per context. A cluster without the setting is an error:
    a machine-local folder would not survive there.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, label: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder, split into folders ``by`` columns, and read it back.

    Cuts lineage like ``checkpoint()`` but stays columnar and compressed. The
    files are deleted by ``discard``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(df._tallyloom_path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

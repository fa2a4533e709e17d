"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, opened by Spark's own reader (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster without it is refused,
    since a machine-local folder would lose files with its executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="querysift-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, with its lineage cut there (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of written() and weak references to what every plan that reads them holds.
_WRITTEN: dict[str, JavaObject] = {}


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: like settled(), but compressed, and readers take single columns.

    swept() deletes it once neither it nor a DataFrame made of it is left."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation())
    return out


def swept(spark: SparkSession) -> None:
    """Has the driver notice which shuffles and written tables no plan needs any more, and their files deleted; else they
    stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
    for path in [p for p, relation in _WRITTEN.items() if relation.get() is None]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _WRITTEN[path]


def let(value: Column, body) -> Column:
    """`body(x)` with x bound to `value`, which Spark then evaluates once a row however often x occurs."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, lengthened until no column of `df` has them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; a local one is set only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's path."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and any executor can read it."""
    return stored(df, label, compression)[0]


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def trim(spark: SparkSession) -> str | None:
    """Hands memory that the driver's JVM has freed outside its heap back to the system; what the JVM reports.

    The C library keeps it otherwise, over a long session more and more.  A JVM that
    does not know the command stays as it is: None.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang

    def array(kind, values: list):
        out = new(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    with contextlib.suppress(Py4JError):
        kinds = [lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        # The server's own class is closed to reflection, its interface is open.
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, kinds))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, [bean, "systemTrimNativeHeap", new(lang.Object, 0), new(lang.String, 0)]))
    return None


class Tables:
    """Tables that an operator writes on its way, and that nothing reads once its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        table, path = stored(df, label, compression)
        self.paths.append(path)
        return table

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
        trim(self.spark)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, path)

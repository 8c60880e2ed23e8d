"""Shared plumbing: shipping the package to executors and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that Python workers can import it wherever the driver runs.

    Arrow batches are made smaller where the session has Spark's own size: texts are long, and a worker holds a batch or two.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="termweave-"), "termweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(out)
    _shipped[app] = True


def release(spark: SparkSession) -> str:
    """Give memory that the driver has freed back to the system; what its JVM says of it, nothing where it cannot.

    The C library keeps what a thread frees in a heap of that thread, and a driver's hundreds of threads come and go with the stages:
    after a few hundred stages that space is a fifth of the driver's memory.
    """
    gc.collect()
    if os.name == "posix" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    gateway = spark.sparkContext._gateway
    java, javax = gateway.jvm.java, gateway.jvm.javax
    args = gateway.new_array(java.lang.Object, 4)
    args[0], args[1] = javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = gateway.new_array(java.lang.Object, 0), gateway.new_array(java.lang.String, 0)
    # the server's own class is not open to callers, its interface is
    invoke = next(m for m in java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        return invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # another JVM, or one that has no such command
        return ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(spark, "_termweave_dir", None)
        if named is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir is unset, and a folder of the driver is none of its executors'")
            named = "file://" + tempfile.mkdtemp(prefix="termweave-shared-")
            spark._termweave_dir = named
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/termweave-{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Cut:
    """A written table in the shared folder: lineage ends here, so lost executors cost nothing upstream."""

    def __init__(self, df: DataFrame, what: str = "cut"):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, what)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    return Cut(df, what).df

"""Intermediate tables in the cluster's shared folder: they cut lineage at a copy that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Stored tables go without what nothing reads: a checksum file by each file, the mark of success. On a local disk each costs the
#: writing JVM a process of its own (``chmod``), which for a moment shares, and so seems to hold, all the memory of its parent.
#: Writers and readers hold row groups whole, so these are small.
WRITE = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",  # else the session's own file system would be used
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "parquet.block.size": str(16 << 20),
}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # a held frame would hold its plan and settings in the driver


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder if all tasks run on this machine, else an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="meridia-"))
    return _own[0]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_at_end(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)


def trim_driver(spark: SparkSession) -> bool:
    """Give native memory that the driver's JVM has freed (compiled plans, threads' arenas) back to the system; False where it can't."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        named = jvm.java.lang.Class.forName
        kinds, values = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, as the server's own class is hidden
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False  # no such command here
    return True


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read back; ``discard`` deletes it, the end of the application at the latest."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meridia-{what}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    df.write.options(**WRITE).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames; nothing may read them any more."""
    for f in frames:
        if (path := _paths.pop(f, None)) is not None:
            fs, target = _file_system(f.sparkSession, path)
            fs.delete(target, True)

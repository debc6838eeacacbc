"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent on a local master (tests) a temporary folder is
    used: the executors of a cluster would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_lamina_dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="lamina-")
            spark._lamina_dir = path
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def give_back(spark: SparkSession) -> None:
    """Return to the system what the driver's JVM has freed outside its heap. The C library
    keeps such memory for each of the threads that Spark starts for jobs and broadcasts, so
    without this the driver grows with the queries of a session. A JVM that has no command
    for it stays as it is."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    java, kind = jvm.java.lang, jvm.java.lang.Class.forName
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = [name, "systemTrimNativeHeap", gateway.new_array(java.Object, 0), gateway.new_array(java.String, 0)]
        args, kinds = gateway.new_array(java.Object, 4), gateway.new_array(java.Class, 4)
        for i, (x, k) in enumerate(zip(given, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))):
            args[i], kinds[i] = x, kind(k)
        # By the interface's method: the server's own class is not open to callers.
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and
    a lost executor costs a reread, not a recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)

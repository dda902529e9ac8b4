"""Written intermediate tables: they cut lineage and survive lost executors.

The folder is the one the session names in `spark.checkpoint.dir`, which every executor shares. Only
a local session without one (tests, a laptop) uses a temporary folder of the driver; a cluster
without one is refused, as its executors could not read each other's files.

Shuffle files of a write are deleted when it ends, as nothing reads them any more; left to the driver's
garbage collection they outgrow the tables of a query of many steps.

The driver gives memory back between writes: each one is planned, compiled and broadcast in hundreds of
its threads, and what they freed would else stay with the heap and with the threads until the session ends.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that shuffle files go with the query that made them (4.1 and later; others ignore it).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Seconds between two times that the driver gives memory back, and at least so many times what one took.
PAUSE, SHARE = 5.0, 20

_fallback: dict[str, str] = {}
#: When the driver may next give memory back.
_relief = {"at": 0.0}


def root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _fallback[app]


def fresh(spark: SparkSession, label: str) -> str:
    """A new path below this application's part of the shared folder."""
    return f"{root(spark)}/siltstone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written there; DataFrames that read it can't be used afterwards."""
    _delete(spark, f"{root(spark)}/siltstone/{spark.sparkContext.applicationId}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = fresh(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    relieve(spark)
    return out


def relieve(spark: SparkSession) -> None:
    """Collect the driver's garbage and give freed memory back to the system, unless that was done just now.

    With the garbage go the broadcasts of earlier writes, here and on executors.
    """
    began = time.monotonic()
    if began < _relief["at"]:
        return
    spark.sparkContext._jvm.java.lang.System.gc()
    trimmed(spark)
    now = time.monotonic()
    _relief["at"] = now + max(PAUSE, SHARE * (now - began))


def trimmed(spark: SparkSession) -> str | None:
    """Give memory that native code of the driver's JVM freed back to the system; what the JVM says of it, or
    None if it has no such command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind: object, *values: object) -> JavaObject:
        out = gateway.new_array(kind, len(values))
        for at, value in enumerate(values):
            out[at] = value
        return out

    named, any_kind, text = jvm.java.lang.Class.forName, jvm.java.lang.Object, jvm.java.lang.String
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # The server's class is hidden in its module, so it is called by its interface.
        kinds = [named(k) for k in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        return invoke.invoke(server, array(any_kind, bean, "systemTrimNativeHeap", array(any_kind), array(text)))
    except Py4JError:
        return None


def discard(*tables: DataFrame) -> None:
    """Delete the files of DataFrames that `written` returned and that nothing will read any more."""
    for table in tables:
        _delete(table.sparkSession, table._siltstone_path)

"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from contextlib import suppress
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import release

ROOT = str(Path(__file__).resolve().parents[2])
#: drops the shuffle files of a query at its end; set while a table is stored, as nothing else reads them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers(spark: SparkSession) -> None:
    """Lets Python workers import this package, in Arrow batches of few rows (texts can be long)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and driver and executors are one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/lexspan"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_driver(spark: SparkSession) -> bool:
    """Free memory of the driver's JVM outside its heap, and of its Python, goes back to the system: plans and compilers leave some hundred MB in
    the allocator's arenas. False where the JVM has no such command."""
    release()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    with suppress(Py4JError, StopIteration):
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new(jvm.Object, 4)
        for i, x in enumerate((bean, "systemTrimNativeHeap", new(jvm.Object, 0), new(jvm.String, 0))):
            args[i] = x
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
        return True
    return False


def release_executors(spark: SparkSession) -> None:
    """Full collection in the executors: a heap that grew for garbage (read buffers, pages of sorts) shrinks to what is alive, and leaves its memory
    to the Python workers beside it. One task a core, so idle executors all get some."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def unused(name: str, columns: list[str]) -> str:
    """name, with an underscore more as long as a column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there, and a lost executor costs nothing.

    The table carries its folder as `.stored_at`, for drop_stored()."""
    spark = df.sparkSession
    path = f"{shared(spark)}/lexspan/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
        release_driver(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, *LETTERS)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows; looks at one row more than that."""
    return df.limit(rows + 1).count() <= rows


def spread_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame, by: str, how: str = "inner", ways: int = 64) -> DataFrame:
    """left.join(right, on, how), where right has at most one row for each key. The keys in heavy (few: they are broadcast) are dealt over
    `ways` tasks: left's rows by the hash of the column `by`, right's rows once to each."""
    mark = F.broadcast(heavy.select(*on).withColumn("_hot", F.lit(True)))
    way = F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")
    one = left.join(mark, on, "left").withColumn("_way", F.when(F.col("_hot"), way).otherwise(0)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    two = right.join(mark, on, "left").withColumn("_way", F.explode(each)).drop("_hot")
    return one.join(two, [*on, "_way"], how).drop("_way")

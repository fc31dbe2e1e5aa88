"""Helpers shared by the operators of this subpackage."""

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one in local
    mode, as in tests; on a cluster that is an error, as its machines don't share such a folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
    context.setCheckpointDir(made)
    return made


def lean(df: DataFrame, most: str = "8m") -> DataFrame:
    """df, whose rows go to Python in batches of at most so many bytes (or one row), so that a task holds little text at
    once. It lowers the session's setting, which by default is eight times as much, and leaves a lower one as it is."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if bytes_of(conf.get(key, "64m")) > bytes_of(most):
        conf.set(key, most)
    return df


def tidy(run: Callable) -> Callable:
    """run, a function of batches, that gives its memory back to the machine when a task ends, as Spark keeps its Python
    workers for later tasks and stages."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # in some C libraries only
                trim(0)

    return own


def fresh(name: str, columns: list[str]) -> str:
    """name, with a mark behind it for as long as one of the columns has it, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "'"
    return name


def bytes_of(size: str) -> int:
    """Of a size as Spark's settings give it: a number, with b, k, m or g."""
    number, unit = re.fullmatch(r"([0-9]+)([bkmg]?)b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit]


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, for small tables that several steps read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again, for large tables that several steps read. The tables
    of an application are removed when its Python driver ends."""
    spark = df.sparkSession
    top = f"{checkpoint_dir(spark)}/quire-{spark.sparkContext.applicationId}"
    if top not in _KEPT:
        _KEPT.add(top)
        atexit.register(removed, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), top)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of stored tables that this driver made.
_KEPT: set[str] = set()


def removed(jvm, conf, path: str) -> None:
    """Deletes a folder by Hadoop's file system, if the JVM still answers."""
    try:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    except (Py4JError, OSError):
        return

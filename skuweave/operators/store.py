"""Keeping what several parts of a plan read, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names (or that was set on the context).

    Where neither is set, a local session gets a folder of its own; on a cluster that is an error, since other executors
    couldn't read a folder of this machine.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "skuweave-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared store that nothing has written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; a lost executor can't take it along.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes it when nothing refers to it any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from all of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Steps that leave each row what it is in its file.
_IN_PLACE = ("Project", "Filter", "SubqueryAlias", "View", "LogicalRelation")


def _read_in_place(df: DataFrame) -> bool:
    """Whether df's rows are rows of files, one each, at most with other columns or fewer of them."""
    plan = df._jdf.queryExecution().analyzed()
    steps, ok = [plan], plan.deterministic()
    while ok and steps:
        step = steps.pop()
        ok = step.nodeName() in _IN_PLACE
        steps += [step.children().apply(i) for i in range(step.children().size())]
    return ok


def identified(df: DataFrame, name: str) -> DataFrame:
    """df with ``name``, a struct (file, at) of longs that tells rows apart and is the same whenever df is read.

    Rows of files go by a hash of the file's path and their place in the file, whatever executors there are and however
    files are split; other rows are stored first, each with a number.  Rows of a file keep their order.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    if _read_in_place(df):
        with contextlib.suppress(AnalysisException):  # a format whose rows have no index
            return df.withColumn(name, place)
    return stored(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))))

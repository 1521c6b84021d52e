"""Helpers shared by the training-data operators: reading tables, Arrow batch mapping, lineage cuts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: A word is a run of characters other than ASCII white space, in every operator of this subpackage that counts words.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Spark's and DuckDB's regular expressions.
WORD_GAP_SQL = r"[\x20\x09-\x0D]+"
#: Rows and bytes that one Arrow batch to Python may hold.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
#: ASCII letters only: lower-casing that leaves other scripts and text lengths alone.
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; spread: one that Spark reads in fewer parts than there are cores (a file of one row group) is dealt over them.

    Texts are long work for few bytes, so that shuffle pays; a table of any size has more parts than that and is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes, as texts may be long; make sure that a checkpoint folder is set.

    The bounds hold for the session, as plans read them only when they run; a session that has set its own keeps them.
    The folder is the shared one that spark.checkpoint.dir names.
    Only a session on one machine (a local master, as in tests) may do without that setting and gets a temporary folder; on a
    cluster a folder of one machine would lose or hide data, so that is an error.
    """
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not spark._jsparkSession.conf().contains(f"spark.sql.execution.arrow.{key}"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        context.setCheckpointDir(folder)
    return spark


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)

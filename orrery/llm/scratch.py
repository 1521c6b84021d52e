"""Tables written to the cluster's shared folder, to cut lineage where a result is read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .common import prepare


class Scratch:
    """Parquet tables in a folder of their own below spark.checkpoint.dir (a session's own checkpoint folder where that is unset).

    A job that loses an executor recomputes from the last table. Tables that later steps no longer need are dropped; those that
    a returned DataFrame reads stay for as long as the shared folder's owner keeps it.
    """

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        self.base = f"{base.rstrip('/')}/orrery-{uuid.uuid4().hex}"
        self.made = 0
        self.held: set[str] = set()

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        self.held.add(path)
        return saved

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def drop_all(self, but: DataFrame) -> None:
        """Drop every table made so far but one."""
        for path in self.held - {but._scratch_path}:
            self._delete(path)

    def _delete(self, name: str) -> None:
        self.held.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

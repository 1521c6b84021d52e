"""Where a live collection keeps its tables: a folder below spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if base is None:  # only a session on one machine may do without a shared folder
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="orrery-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base.rstrip('/')}/orrery-collection-{uuid.uuid4().hex}"
        self.made = 0

    def path(self) -> str:
        self.made += 1
        return f"{self.base}/{self.made}"

    def write(self, df: DataFrame, lookup: str | None = None) -> str:
        """A table at a path of its own; by values of the column ``lookup`` its row groups can be skipped (Bloom filters)."""
        path, writer = self.path(), df.write
        if lookup:
            writer = writer.option(f"parquet.bloom.filter.enabled#{lookup}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(path)
        return path

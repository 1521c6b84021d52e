"""Saved collections: a folder of Parquet tables and a manifest with each file's length and SHA-256, replaced in one rename."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0.0"
MANIFEST = "manifest.json"
#: Bytes of a manifest at most: about 100 for each file.
MOST_MANIFEST = 256 << 20


class Folder:
    """File operations by Hadoop's file systems, so that any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def at(self, path: str) -> tuple[Any, Any]:
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.conf), place

    def exists(self, path: str) -> bool:
        fs, place = self.at(path)
        return fs.exists(place)

    def delete(self, path: str) -> None:
        fs, place = self.at(path)
        fs.delete(place, True)

    def rename(self, path: str, to: str) -> None:
        fs, place = self.at(path)
        if not fs.rename(place, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise RuntimeError(f"Could not rename {path} to {to}")

    def write(self, path: str, text: str) -> None:
        fs, place = self.at(path)
        out = fs.create(place, True)
        out.write(text.encode())
        out.close()

    def read(self, path: str, most: int) -> str:
        """The text of a file of so many bytes at most; one that is longer is not read."""
        fs, place = self.at(path)
        if (length := fs.getFileStatus(place).getLen()) > most:
            raise ValueError(f"{path} has {length} bytes, more than the {most} that it can have")
        source = fs.open(place)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()


def digests(spark: SparkSession, path: str, names: list[str]) -> dict[str, list]:
    """Length and SHA-256 of each data file below the named tables, computed where the files are read."""
    found: dict[str, list] = {}
    for name in names:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/{name}")
        for r in files.select("path", "length", F.sha2("content", 256).alias("sha256")).collect():
            found[f"{name}/{r.path.rsplit('/', 1)[1]}"] = [r.length, r.sha256]
    return found


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict[str, Any], rows_a_file: int = 100_000) -> None:
    """Write everything beside the target, the manifest last, then swap folders: a reader finds the old or the new one whole.

    Files hold so many rows at most, as a digest is taken of a whole file in a task's memory.
    """
    folder = Folder(spark)
    path = path.rstrip("/")
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old"
    repair(spark, path)
    try:
        for name, df in tables.items():
            df.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{staging}/{name}")
        folder.write(f"{staging}/{MANIFEST}", json.dumps(manifest | {"format_version": VERSION, "tables": sorted(tables), "files": digests(spark, staging, sorted(tables))}))
        if folder.exists(path):
            folder.rename(path, old)
        folder.rename(staging, path)
    except BaseException:
        folder.delete(staging)
        repair(spark, path)
        raise
    folder.delete(old)


def repair(spark: SparkSession, path: str) -> None:
    """After a save that broke off between its two renames: put the old folder back."""
    folder = Folder(spark)
    old = f"{path.rstrip('/')}.old"
    if folder.exists(old):
        if folder.exists(path):
            folder.delete(old)
        else:
            folder.rename(old, path)


def load(spark: SparkSession, path: str) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    """The manifest and tables of a saved collection, after every file's length and digest has been verified."""
    folder = Folder(spark)
    path = path.rstrip("/")
    repair(spark, path)
    if not folder.exists(f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"No saved collection at {path}: {MANIFEST} is missing")
    try:
        manifest = json.loads(folder.read(f"{path}/{MANIFEST}", MOST_MANIFEST))
        version, files, names = str(manifest["format_version"]), manifest["files"], manifest["tables"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"{path}/{MANIFEST} cannot be read: {e}") from e
    if not isinstance(files, dict) or not isinstance(names, list) or not all(isinstance(n, str) and n.isidentifier() for n in names) or "records" not in names:
        raise ValueError(f"{path}/{MANIFEST} cannot be read: its tables or files are not as they must be")
    if version.split(".")[0] != VERSION.split(".")[0]:
        raise ValueError(f"Format version {version} cannot be read; this reads {VERSION.split('.')[0]}.x")
    for name in names:
        if not folder.exists(f"{path}/{name}"):
            raise FileNotFoundError(f"{path}: table {name} is missing")
    there = digests(spark, path, names)
    for name, known in files.items():
        if name not in there:
            raise FileNotFoundError(f"{path}: {name} is missing")
        if there[name] != known:
            raise ValueError(f"{path}: {name} is damaged (its length or digest differs from the manifest's)")
    if extra := sorted(set(there) - set(files)):
        raise ValueError(f"{path}: {extra[0]} does not belong to the collection")
    return manifest, {name: spark.read.parquet(f"{path}/{name}") for name in names}


def describe(spark: SparkSession, path: str) -> dict[str, Any]:
    """The manifest of a saved collection, without reading or verifying its tables."""
    folder = Folder(spark)
    path = path.rstrip("/")
    repair(spark, path)
    if not folder.exists(f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"No saved collection at {path}: {MANIFEST} is missing")
    return json.loads(folder.read(f"{path}/{MANIFEST}", MOST_MANIFEST))

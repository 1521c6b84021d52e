"""The entry point: create and load collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from .collection import Collection
from .plans.config import check, check_fields, check_quantization
from .sources.storage import describe


class VectorDatabase:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()

    def create(self, index_type: str = "hnsw", quantization_config: dict[str, Any] | None = None, **parameters: Any) -> Collection:
        """A new collection: dim (required), space, m, ef_construction, expected_size, indexed_fields."""
        if str(index_type).lower() not in self.available_index_types():
            raise ValueError(f"Unknown index type '{index_type}'. Available: {', '.join(self.available_index_types())}")
        unknown = set(parameters) - {"dim", "space", "m", "ef_construction", "expected_size", "indexed_fields"}
        if unknown:
            raise TypeError(f"create() got an unexpected argument: '{sorted(unknown)[0]}'")
        if "dim" not in parameters:
            raise TypeError("create() missing a required argument: 'dim'")
        fields = check_fields(parameters.pop("indexed_fields", None))
        try:
            config = check(**parameters, indexed_fields=fields)
        except ValueError as e:
            raise RuntimeError(f"Failed to create {str(index_type).upper()} index: {e}") from e
        config.quantization = check_quantization(quantization_config, config.dim, config.space, config.expected_size)
        return Collection(self.spark, config)

    def load(self, path: str) -> Collection:
        return Collection.load(self.spark, path)

    def get_index_info(self, path: str) -> dict[str, Any]:
        """Configuration, record count and files of a saved collection, from its manifest."""
        return describe(self.spark, path)

    @classmethod
    def available_index_types(cls) -> list[str]:
        return ["hnsw"]

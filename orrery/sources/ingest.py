"""What add() accepts, turned into plain records, and records turned into stored rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.values import FIELD, fields, stored
from ..operators.quantize import assign, encode_block


@dataclass
class AddResult:
    total_inserted: int = 0
    total_errors: int = 0
    errors: list[str] = field(default_factory=list)
    vector_shape: tuple[int, int] | None = None
    ids: list[str] = field(default_factory=list)

    def is_success(self) -> bool:
        return self.total_errors == 0

    def summary(self) -> str:
        return f"{self.total_inserted} inserted, {self.total_errors} errors"

    def __repr__(self) -> str:
        shape = "None" if self.vector_shape is None else f"Some({self.vector_shape})"
        return f"AddResult(inserted={self.total_inserted}, errors={self.total_errors}, shape={shape})"


#: id (None: generate one), vector, metadata
Record = tuple[str | None, list[float], dict[str, Any]]


def check_vector(value: Any, dim: int, word: str = "Vector") -> list[float]:
    """The vector as floats (32 bits), or ValueError for what is wrong with it; errors name the first bad place."""
    if isinstance(value, (str, bytes)) or value is None:
        raise ValueError(f"{word} must be a list of numbers")
    try:
        x = np.asarray(value, dtype=np.float64)
    except (TypeError, ValueError):
        raise ValueError(f"{word} must be a list of numbers") from None
    if x.ndim != 1:
        raise ValueError(f"{word} must have one dimension, got {x.ndim}")
    if len(x) == 0:
        raise ValueError(f"{word} cannot be empty")
    if len(x) != dim:
        raise ValueError(f"{word} dimension mismatch: expected {dim}, got {len(x)}")
    with np.errstate(over="ignore"):
        x = x.astype(np.float32)
    bad = np.flatnonzero(~np.isfinite(x))
    if len(bad):
        raise ValueError(f"{word} contains invalid value at index {bad[0]}: {x[bad[0]]}" + (" (must be finite)" if word == "Vector" else ""))
    return x.tolist()


def _metadata(value: Any, wrap: bool) -> dict[str, Any]:
    """A mapping as it is; otherwise {} (one object, NumPy batches) or the value wrapped as text or value (lists)."""
    if isinstance(value, dict):
        return stored(value)
    if value is None or not wrap:
        return {}
    return {"text" if isinstance(value, str) else "value": stored(value)}


def _first(data: dict, *names: str) -> Any:
    return next((data[n] for n in names if data.get(n) is not None), None)


def records(data: Any, dim: int) -> tuple[list[Record], list[str]]:
    """The records of any accepted input and an error for each bad one; raises TypeError or ValueError where nothing can be taken."""
    if data is None:
        raise ValueError("Data cannot be None")
    if isinstance(data, np.ndarray):
        return _matrix(data, None, None, dim) if data.ndim == 2 else _one(None, data, {}, dim)
    if isinstance(data, dict):
        return _mapping(data, dim)
    if isinstance(data, (list, tuple)):
        if data and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in data):
            return _one(None, data, {}, dim)
        return _objects(data, dim)
    raise TypeError(f"Cannot add data of type {type(data).__name__}")


def _one(name: str | None, vector: Any, metadata: dict, dim: int) -> tuple[list[Record], list[str]]:
    try:
        return [(name, check_vector(vector, dim), metadata)], []
    except ValueError as e:
        return [], [f"Vector {name}: {e}" if name else f"Single vector error: {e}"]


def _mapping(data: dict, dim: int) -> tuple[list[Record], list[str]]:
    vectors = _first(data, "vectors", "embeddings", "values")
    plural = "ids" in data or "vectors" in data or "embeddings" in data or isinstance(data.get("values"), np.ndarray) and data["values"].ndim == 2 or isinstance(data.get("values"), (list, tuple)) and len(data["values"]) and isinstance(data["values"][0], (list, tuple, np.ndarray))
    if not plural:
        vector = _first(data, "values", "vector")
        if vector is None:
            raise ValueError("There is no vector: give one as 'values' or 'vector', several as 'vectors' or 'embeddings'")
        name = data.get("id")
        return _one(name if isinstance(name, str) else None, vector, _metadata(data.get("metadata"), False), dim)
    ids, metadatas = data.get("ids"), _first(data, "metadatas", "metadata")
    if ids is not None and not isinstance(ids, (list, tuple)):
        raise TypeError("ids must be a list of strings")
    if not isinstance(metadatas, (list, tuple)):
        metadatas = None
    if vectors is None:
        return [], ["Missing vector data: several vectors come as 'vectors', 'embeddings' or 'values'"]
    if isinstance(vectors, (str, dict)):
        raise ValueError("Several vectors come as a list or a matrix")
    for word, other in (("ids", ids), ("metadatas", metadatas)):
        if other is not None and len(other) != len(vectors):
            raise ValueError(f"{len(vectors)} vectors but {len(other)} {word}")
    if isinstance(vectors, np.ndarray):
        return _matrix(vectors, ids, metadatas, dim)
    good: list[Record] = []
    errors = []
    for i, vector in enumerate(vectors):
        name = ids[i] if ids is not None and isinstance(ids[i], str) else None
        try:
            good.append((name, check_vector(vector, dim), _metadata(metadatas[i] if metadatas else None, True)))
        except ValueError as e:
            errors.append(f"Vector {name or i}: {e}")
    return good, errors


def _matrix(matrix: np.ndarray, ids: Any, metadatas: Any, dim: int) -> tuple[list[Record], list[str]]:
    if matrix.ndim != 2 or matrix.shape[1] != dim:
        return [], [f"The matrix must have {dim} columns, its shape is {list(matrix.shape)}"]
    good: list[Record] = []
    errors = []
    for i, row in enumerate(matrix):
        name = ids[i] if ids is not None and isinstance(ids[i], str) else None
        try:
            good.append((name, check_vector(row, dim), _metadata(metadatas[i] if metadatas else None, False)))
        except ValueError as e:
            errors.append(f"Vector {name or i}: {e}")
    return good, errors


def _objects(data: list | tuple, dim: int) -> tuple[list[Record], list[str]]:
    good: list[Record] = []
    errors = []
    for i, item in enumerate(data):
        if not isinstance(item, dict):
            name, vector, metadata = None, item, {}
        else:
            name = item.get("id") if isinstance(item.get("id"), str) else None
            vector, metadata = _first(item, "vector", "values"), _metadata(item.get("metadata"), True)
            if vector is None:
                errors.append(f"Item {i}: Missing vector data")
                continue
        try:
            good.append((name, check_vector(vector, dim), metadata))
        except ValueError as e:
            errors.append(f"Vector {name}: {e}" if name else f"Item {i}: {e}")
    return good, errors


def declared_type(names: list[str]) -> str:
    """Declared fields get a column of their own each, so that conditions on them read nothing else and push down."""
    return "struct<" + ",".join(f"f{i}:{FIELD}" for i in range(len(names))) + ">" if names else ""


def row_schema(names: list[str]) -> str:
    return "row_id long, id string, seq long, vector array<float>, code binary, cell int, json string, fields map<string," + FIELD + ">" + (f", declared {declared_type(names)}" if names else "")


def stored_rows(df: DataFrame, space: str, names: list[str], codebook: np.ndarray | None, cells: np.ndarray | None, keep_raw: bool) -> DataFrame:
    """Rows (row_id, id, seq, vector, json) in stored form: unit vectors for cosine (a zero vector as it is), codes, cell, metadata columns."""
    shared = df.sparkSession.sparkContext.broadcast((codebook, cells))
    kind = pa.struct([("kind", pa.string()), ("text", pa.string()), ("num", pa.float64()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook, cells = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
            if space == "cosine":
                norm = np.sqrt((x * x).sum(1, dtype=np.float32, keepdims=True))
                x = np.where(norm > 0, x / np.where(norm > 0, norm, 1), x).astype(np.float32)
            texts = [t or "{}" for t in batch.column("json").to_pylist()]
            found = [fields(json.loads(t)) for t in texts]
            n = batch.num_rows
            columns = {
                "row_id": batch.column("row_id"),
                "id": batch.column("id"),
                "seq": batch.column("seq"),
                "vector": pa.array(x.tolist(), pa.list_(pa.float32())) if keep_raw or codebook is None else pa.nulls(n, pa.list_(pa.float32())),
                "code": pa.nulls(n, pa.binary()) if codebook is None else pa.array([c.tobytes() for c in encode_block(x, codebook)], pa.binary()),
                "cell": pa.nulls(n, pa.int32()) if cells is None else pa.array(assign(x.astype(float), cells)[0].astype(np.int32)),
                "json": pa.array(texts, pa.string()),
                "fields": pa.array([list(f.items()) for f in found], pa.map_(pa.string(), kind)),
            }
            if names:
                columns["declared"] = pa.array([{f"f{i}": f.get(name) for i, name in enumerate(names)} for f in found], pa.struct([(f"f{i}", kind) for i in range(len(names))]))
            yield pa.RecordBatch.from_pydict(columns)

    return df.select("row_id", "id", "seq", "vector", "json").mapInArrow(run, row_schema(names))

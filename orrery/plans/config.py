"""Parameters of a collection: limits, defaults, warnings."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from typing import Any

from ..functions.filters import GROUPS, NEGATION
from ..functions.metrics import SPACES

#: Fixed limits.
MAX_DIM, MAX_EF_CONSTRUCTION, MAX_EXPECTED, MIN_M, MAX_M, MAX_FIELDS = 65_536, 4_096, 100_000_000, 2, 256, 32
MAX_TOP_K, MAX_EF_SEARCH = 65_536, 131_072
STORAGE_MODES = ("quantized_only", "quantized_with_raw")


@dataclass
class Quantization:
    subvectors: int
    bits: int
    training_size: int
    max_training_vectors: int | None
    storage_mode: str

    @property
    def centroids(self) -> int:
        return 2**self.bits


@dataclass
class Config:
    dim: int
    space: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    expected_size: int = 10_000
    quantization: Quantization | None = None
    indexed_fields: list[str] = field(default_factory=list)


def _whole(name: str, value: Any, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer, got {type(value).__name__}")
    if value < low:
        raise ValueError(f"{name} must be positive, got {value}" if low == 1 else f"{name} must be at least {low}, got {value}")
    if value > high:
        raise ValueError(f"{name} must be less than or equal to {high}, got {value}")
    return value


def check_fields(names: Any) -> list[str]:
    if names is None:
        return []
    if isinstance(names, str) or not isinstance(names, (list, tuple)):
        raise ValueError("indexed_fields must be a list of field names, not a string")
    if len(names) > MAX_FIELDS:
        raise ValueError(f"indexed_fields takes at most {MAX_FIELDS} names, got {len(names)}")
    for name in names:
        if not isinstance(name, str):
            raise ValueError(f"indexed_fields must hold strings, got {type(name).__name__}")
        if not name:
            raise ValueError("indexed_fields must not hold an empty name")
        if name in (*GROUPS, NEGATION):
            raise ValueError(f"'{name}' is a filter group and cannot be a field name")
    if len(set(names)) != len(names):
        raise ValueError("indexed_fields must not hold a name twice")
    return list(names)


def default_subvectors(dim: int) -> int:
    """The divisor of dim nearest to dim / 32 among those from 8 to 192 (ties: the larger), else the nearest up to 192."""
    target = min(max(round(dim / 32), 8), 192)
    divisors = [d for d in range(1, 193) if dim % d == 0]
    return min([d for d in divisors if d >= 8] or divisors, key=lambda d: (abs(d - target), -d))


def default_training_size(bits: int) -> int:
    return min(max(20 * 2**bits, 10_000), 200_000)


def fixed_bytes(dim: int, subvectors: int, bits: int) -> int:
    """Bytes of a trained codebook and of its centroid distance table."""
    k = 2**bits
    return 4 * (k * dim + subvectors * math.comb(k, 2))


def check_quantization(given: Any, dim: int, space: str, expected_size: int) -> Quantization | None:
    if given is None:
        return None
    if not isinstance(given, dict):
        raise ValueError("quantization_config takes a mapping of its settings")
    kind = str(given.get("type", "")).lower()
    if kind != "pq":
        raise ValueError(f"Unsupported quantization type: '{kind}'. Currently only 'pq' is supported.")
    if space == "dot":
        raise ValueError("The dot space cannot be quantized")
    subvectors = given.get("subvectors")
    derived = subvectors is None
    if derived:
        subvectors = default_subvectors(dim)
    if isinstance(subvectors, bool) or not isinstance(subvectors, int) or subvectors <= 0:
        raise ValueError(f"subvectors must be a positive integer, got {subvectors}")
    if subvectors > dim:
        raise ValueError(f"subvectors ({subvectors}) cannot exceed dimension ({dim})")
    if dim % subvectors:
        raise ValueError(f"subvectors ({subvectors}) must divide dimension ({dim}) evenly")
    bits = given.get("bits", 8)
    if isinstance(bits, bool) or not isinstance(bits, int) or not 1 <= bits <= 8:
        raise ValueError(f"bits must be an integer between 1 and 8, got {bits}")
    training = given.get("training_size") or default_training_size(bits)
    if isinstance(training, bool) or not isinstance(training, int) or training < 1000:
        raise ValueError(f"training_size must be at least 1000 (centroids need that many to be well placed), got {training}")
    most = given.get("max_training_vectors")
    if most is not None and most < training:
        raise ValueError(f"max_training_vectors ({most}) must be >= training_size ({training})")
    mode = str(given.get("storage_mode", "quantized_only")).lower()
    if mode not in STORAGE_MODES:
        raise ValueError(f"Invalid storage_mode: '{mode}'. Supported: quantized_only, quantized_with_raw")
    _warn_quantization(dim, subvectors, bits, training, mode, expected_size, derived)
    return Quantization(subvectors, bits, training, most, mode)


def _warn_quantization(dim: int, subvectors: int, bits: int, training: int, mode: str, expected: int, derived: bool) -> None:
    say = lambda text: warnings.warn(text, UserWarning, stacklevel=5)
    fixed, saved = fixed_bytes(dim, subvectors, bits), 4 * dim - 2 * subvectors
    never = expected < training
    if never:
        say(f"expected_size={expected} is below training_size={training}: training will not start at that size, and nothing will be quantized.")
    pays_from = math.ceil(fixed / saved) if mode == "quantized_only" and saved > 0 else None
    short = not never and pays_from is not None and expected < pays_from
    if short:
        say(f"At expected_size={expected} this quantization takes more memory than none: its tables take {fixed / 2**20:.2f}MB, and it saves from {pays_from} records on.")
    if fixed > 50 * 2**20 and not short and not never:
        say(f"Large fixed quantization memory: {fixed / 2**20:.1f}MB at any record count. Fewer bits ({bits}) or subvectors ({subvectors}) lower it.")
    if mode == "quantized_with_raw" and not never:
        say("storage_mode='quantized_with_raw' keeps every raw vector besides its code, so it takes more memory than no quantization.")
    if 4 * dim / subvectors > 50 and not derived:
        say(f"Very high compression ratio: {4 * dim / subvectors:.1f}x may lower recall a lot. More subvectors ({subvectors}) lower the ratio.")


def check(dim: Any = None, space: Any = "cosine", m: Any = None, ef_construction: Any = 200, expected_size: Any = 10_000, indexed_fields: Any = None) -> Config:
    """The checked configuration; raises what is wrong with it."""
    if dim is None:
        raise TypeError("create() missing a required argument: 'dim'")
    dim = _whole("dim", dim, 1, MAX_DIM)
    expected_size = _whole("expected_size", expected_size, 1, MAX_EXPECTED)
    ef_construction = _whole("ef_construction", ef_construction, 1, MAX_EF_CONSTRUCTION)
    m = _whole("m", (16 if expected_size <= 25_000 else 32) if m is None else m, MIN_M, MAX_M)
    if not isinstance(space, str) or space.lower() not in SPACES:
        raise ValueError(f"Unsupported space: '{space}'. Supported spaces: 'cosine', 'l2', 'l1', 'dot'")
    names = check_fields(indexed_fields)
    if ef_construction <= 2 * m:
        warnings.warn(f"ef_construction={ef_construction} is at most twice m={m}: neighbour selection has nothing to choose from.", UserWarning, stacklevel=4)
    return Config(dim, space.lower(), m, ef_construction, expected_size, None, names)

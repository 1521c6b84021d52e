"""Vector collections on Spark: exact and approximate nearest neighbours, metadata filters, quantisation, persistence."""

from .collection import Collection, HNSWIndex
from .database import VectorDatabase
from .logs import init_file_logging, init_logging, is_logging_initialized
from .sources.ingest import AddResult

__version__ = "0.1.0"
__all__ = ["AddResult", "Collection", "HNSWIndex", "VectorDatabase", "__version__", "init_file_logging", "init_logging", "is_logging_initialized"]

"""Call logs as tables: schemas, the Parquet store and the mapping of relational tables to calls."""

from .ingest import Log, facts, open_log
from .store import Store

__all__ = ["Log", "Store", "facts", "open_log"]

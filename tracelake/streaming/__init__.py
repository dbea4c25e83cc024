"""Call rows that arrive as streams."""

from .ingest import call_rates, ingest_calls

__all__ = ["call_rates", "ingest_calls"]

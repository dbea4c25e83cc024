"""The query catalogue and its SQL twins."""

from . import stored  # noqa: F401  its queries add themselves
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

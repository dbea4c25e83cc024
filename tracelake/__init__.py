"""Memoized computations and provenance analytics on Spark DataFrames."""

from .functions.types import MDict, MList, MSet, MTuple
from .operators import Call, Frame, Ignore, NewArgDefault, Op, Ref, Storage, ValuePointer, noop, op, track
from .sources import Log, Store, open_log

__all__ = ["Call", "Frame", "Ignore", "Log", "MDict", "MList", "MSet", "MTuple", "NewArgDefault", "Op", "Ref", "Storage", "Store", "ValuePointer", "noop", "op", "open_log", "track"]

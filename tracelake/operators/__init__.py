"""Operators on call logs: memoized execution, provenance, frames and code versions."""

from .frame import Frame
from .memo import Storage
from .model import Call, Ignore, NewArgDefault, Op, Ref, ValuePointer, noop, op
from .versions import track

__all__ = ["Call", "Frame", "Ignore", "NewArgDefault", "Op", "Ref", "Storage", "ValuePointer", "noop", "op", "track"]

"""Commerce and marketing analytics written as Spark DataFrame functions."""

from merchantry.config import Settings, Store
from merchantry.session import build_session

__all__ = ["Settings", "Store", "build_session"]

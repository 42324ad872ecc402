"""Opening inputs that may be absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def is_missing(error: Exception) -> bool:
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"


def open_or_none(read: Callable[[str], DataFrame], path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing is there."""
    try:
        return read(path)
    except FileNotFoundError:
        return None
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise


def open_required(read: Callable[[str], DataFrame], path: str) -> DataFrame:
    found = open_or_none(read, path)
    if found is None:
        raise FileNotFoundError(f"nothing to read at {path}")
    return found

"""What a failed read of stored files means."""

from __future__ import annotations

from pyspark.errors import AnalysisException


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing has been written there yet."""
    return error.getCondition() == "PATH_NOT_FOUND"

"""Arrow-batched functions declared with a DDL type before any session exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(kind: str) -> Callable:
    """Like ``pandas_udf``, made at the first call."""

    def declare(f: Callable) -> Callable[..., Column]:
        made: list = []

        def declared():
            if not made:
                made.append(F.pandas_udf(f, kind))
            return made[0]

        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return declared()(*columns)

        call.declared = declared
        return call

    return declare

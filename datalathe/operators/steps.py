"""Base of all column treatments: learn small parameters once, apply them anywhere.

``fit`` reads the data and returns a :class:`Fitted`, whose ``state`` is plain JSON
data where it is small; ``Fitted.apply`` only builds column expressions or joins, so
a fitted treatment can be kept, shown, or applied to other data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Fitted:
    operation: str
    params: dict[str, Any]
    state: dict[str, Any] = field(default_factory=dict)
    transform: Callable[[DataFrame], DataFrame] = field(default=lambda df: df, repr=False, compare=False)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

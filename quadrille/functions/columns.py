"""Small helpers for long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(v: Column, use: Callable[[Column], Column]) -> Column:
    """use(v) with v evaluated once; without it, a long expression is copied wherever its parts are looked at."""
    return F.element_at(F.transform(F.array(v), use), 1)

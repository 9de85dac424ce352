"""Vectors as JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(vector: str | Column) -> Column:
    return F.to_json(F.col(vector) if isinstance(vector, str) else vector)


def decoded(text: str | Column) -> Column:
    return F.from_json(F.col(text) if isinstance(text, str) else text, "array<float>")

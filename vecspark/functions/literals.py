"""Vectors as text: ``[x1,x2,...]`` and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_vector_literal(v) -> Column:
    """Text with the shortest decimals that read back to the same numbers."""
    v = F.col(v) if isinstance(v, str) else v
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def from_vector_literal(text, dim: int | None = None, element: str = "float") -> Column:
    """Array from text; a null element, or a size other than ``dim``, is an error."""
    text = F.col(text) if isinstance(text, str) else text
    v = F.from_json(F.trim(text), f"array<{element}>")
    v = F.when(F.exists(v, lambda x: x.isNull()), F.raise_error(F.lit("null element in a vector"))).otherwise(v)
    if dim is None:
        return v
    wrong = F.raise_error(
        F.concat(F.lit(f"expected {dim} dimensions, not "), F.coalesce(F.size(v), F.lit(-1)).cast("string"))
    )
    return F.when(text.isNull(), F.lit(None)).when(F.coalesce(F.size(v), F.lit(-1)) == dim, v).otherwise(wrong)

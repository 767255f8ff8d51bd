"""Small helpers for building long-form result rows inside a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stack_rows(names: list[str], rows: list[tuple]) -> Column:
    """``inline`` generator of ``rows`` (tuples of Columns / literals) with the
    field ``names`` applied to every struct, so the structs unify."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.inline(F.array(*[F.struct(*[lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]))

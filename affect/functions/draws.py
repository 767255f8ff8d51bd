"""Seeded, partition-independent random draws.

A draw is a hash of (seed, row id, step), so the value of a row never
depends on partitioning, task retries or executor loss — a recomputed
partition produces the same sample.  The same expression exists in DuckDB,
which lets the oracle reproduce every sampled result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed, id_col, step: str = "") -> Column:
    """Hex md5 of ``seed:id:step`` — a sort key for seeded sampling."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), idc.cast("string"), F.lit(str(step))))


def uniform(seed, id_col, step: str = "") -> Column:
    """Uniform draw in [0, 1): first 8 hex digits of the key / 2**32."""
    h = draw_key(seed, id_col, step)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed, id_expr: str, step: str = "") -> str:
    """The DuckDB text of :func:`uniform` (used by the oracle)."""
    h = f"md5(concat_ws(':', '{seed}', CAST({id_expr} AS VARCHAR), '{step}'))"
    return f"(CAST(('0x' || substr({h},1,8)) AS BIGINT) / 4294967296.0)"


def draw_key_sql(seed, id_expr: str, step: str = "") -> str:
    return f"md5(concat_ws(':', '{seed}', CAST({id_expr} AS VARCHAR), '{step}'))"

"""Exact, seeded, skew-safe "first k rows per group by hash draw".

Many operators keep, per group, the ``quota`` rows with the smallest seeded
draw (stratified split, down-sampling, example retrieval, expansion passes).
A ``row_number()`` window over the raw rows would sort a whole group inside
one task — with one label holding a third of 100 TB that is unacceptable.

Instead:

1. Group, draw and tie of every row — no text — are written once.
2. The 32-bit draw is bucketed into ``2**bits`` bins and counted (a partial/final
   hash aggregate, skew-safe); a running sum per key finds the boundary bin
   where the quota is crossed.
3. Only the boundary bin's rows (about ``n_key / 2**bits``) are ranked, which
   gives each key one cut: the (draw, tie) of its last row.
4. The rows themselves are read once more and kept where their (draw, tie) is
   not past the cut: one join with a table of a row per key, no sort, no window.

The selection equals ``row_number() over (partition by keys order by draw,
tie) <= quota`` — which is what the DuckDB oracles state.  Where several rows
share the draw and tie of a cut (repeated ids), those rows alone are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affect.session import materialize


def draw_long(seed, id_col, step: str | Column = "") -> Column:
    """32-bit unsigned integer draw from md5(seed:id:step)."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), idc.cast("string"), step if isinstance(step, Column) else F.lit(str(step))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def draw_long_sql(seed, id_expr: str, step: str = "") -> str:
    h = f"md5(concat_ws(':', '{seed}', CAST({id_expr} AS VARCHAR), '{step}'))"
    return f"CAST(('0x' || substr({h},1,8)) AS BIGINT)"


def lowest_by_draw(df: DataFrame, keys: list[str], quota, draw: Column,
                   tie: str, bits: int = 20, quota_col: str = "__quota",
                   flag: str | None = None) -> DataFrame:
    """Keep, per ``keys`` group, the ``quota`` rows with the smallest
    (``draw``, ``tie``).  ``quota`` is a small DataFrame (keys + quota_col),
    one row per group; groups missing from it keep nothing.

    ``quota`` may also be a function of the per-group counts (keys,
    ``__n``) returning that table; the counts then come from the same
    histogram.  The input is read twice in total.

    With ``flag`` set, every row is returned and the boolean column ``flag``
    marks the selected ones.  ``__rank_draw`` (the 32-bit draw) is added.
    """
    narrow = materialize(df.select(*keys, draw.alias("__rank_draw"), F.col(tie).alias("__tie")), "draws")
    narrow = narrow.withColumn("__bin", F.shiftright(F.col("__rank_draw"), 32 - bits))
    hist = narrow.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__cnt"))
    if callable(quota):
        quota = quota(hist.groupBy(*keys).agg(F.sum("__cnt").alias("__n")))
    w = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = (hist.join(quota.select(*keys, quota_col), on=keys, how="inner")
               .withColumn("__cum", F.sum("__cnt").over(w)).withColumn("__prev", F.col("__cum") - F.col("__cnt"))
               .withColumn("__total", F.sum("__cnt").over(Window.partitionBy(*keys))))
    crossed = (F.col("__cum") >= F.col(quota_col)) & (F.col("__prev") < F.col(quota_col))
    # one row per group: the boundary bin and how many of its rows to keep; a group smaller than its quota: its last bin, whole
    short = (F.col("__total") < F.col(quota_col)) & (F.col("__cum") == F.col("__total"))
    bound = cum.where(crossed | short).select(*keys, "__bin", F.when(short, F.col("__cnt")).otherwise(F.col(quota_col) - F.col("__prev")).alias("__need"))
    order = Window.partitionBy(*keys).orderBy("__rank_draw", "__tie")
    same = Window.partitionBy(*keys, "__rank_draw", "__tie")
    ranked = narrow.join(bound, on=[*keys, "__bin"]).withColumn("__r", F.row_number().over(order))
    ranked = ranked.withColumn("__alike", F.count(F.lit(1)).over(same)).withColumn("__first", F.min("__r").over(same))
    cuts = materialize(ranked.where("__r = __need").select(*keys, F.col("__rank_draw").alias("__cut"), F.col("__tie").alias("__cut_tie"),
                                                           "__alike", (F.col("__need") - F.col("__first") + 1).alias("__some")), "cuts")
    j = df.withColumn("__rank_draw", draw)
    if not flag:  # no group goes past the highest cut: rows beyond it go before what the input derives for them is worked out
        j = j.where(F.col("__rank_draw") <= cuts.agg(F.max("__cut")).scalar())
    j = j.join(cuts, on=keys, how="left" if flag else "inner")
    at = (F.col("__rank_draw") == F.col("__cut")) & F.col(tie).eqNullSafe(F.col("__cut_tie"))
    # nulls of the tie come first, as they do in the ranking
    before = (F.col("__rank_draw") < F.col("__cut")) | ((F.col("__rank_draw") == F.col("__cut")) & (F.col(tie).isNull() | F.coalesce(F.col(tie) <= F.col("__cut_tie"), F.lit(False))))
    if cuts.where("__alike > __some").isEmpty():
        out = j.withColumn("__sel", F.coalesce(before, F.lit(False)))
    else:
        at = F.coalesce(at, F.lit(False))
        out = j.where(~at).withColumn("__sel", F.coalesce(before, F.lit(False)))
        alike = j.where(at).withColumn("__sel", F.row_number().over(Window.partitionBy(*keys).orderBy(tie)) <= F.col("__some"))
        out = out.unionByName(alike)
    out = out.drop("__cut", "__cut_tie", "__alike", "__some")
    if flag:
        return out.withColumnRenamed("__sel", flag)
    return out.where(F.col("__sel")).drop("__sel")

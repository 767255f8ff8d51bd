"""Order statistics of groups of any size: exact quantiles and sums over ranks.

No group is ever sorted, or ranked, by one task.  Quantiles are found by
repeated refinement of histograms; ranks of all values come from a range
partitioning whose parts are ranked apart and shifted by what lies before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affect.session import materialize

#: Steps for each power of two of the first histogram; bins that a crowded bin is split into; rows of a bin that are ranked at most.
STEPS, BINS, RANKED = 256, 4096, 100_000
#: Ranks that one row stands for when sums over ranks are taken.
CHUNK = 10_000


def magnitude(x: str, steps: int = STEPS) -> Column:
    """A whole number that rises with the value: so many steps for each power of two, mirrored for negative values."""
    v = F.col(x)
    n = F.floor((F.log2(F.least(F.abs(v), F.lit(1.7976931348623157e308))) + 1100) * steps)
    return F.when(v == 0, F.lit(0)).when(v > 0, n).otherwise(-n).cast("long")


def _histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, least and greatest value of every bin, written: the rows are read once for it."""
    hist = rows.groupBy(*by, "__parent", "__bin").agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    return materialize(hist, "histogram")


def _locate(hist: DataFrame, need: DataFrame, by: list[str]) -> DataFrame:
    """``need`` (by, __parent, p, __side, __frac, __rank within the parent) with the bin of each rank, and the rank within it."""
    w = Window.partitionBy(*by, "__parent").orderBy("__lo")
    ends = hist.withColumn("__end", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = need.join(ends, [*by, "__parent"]).where((F.col("__rank") < F.col("__end")) & (F.col("__rank") >= F.col("__end") - F.col("__c")))
    return materialize(found.withColumn("__rank", F.col("__rank") - (F.col("__end") - F.col("__c"))).drop("__parent", "__end"), "located")


def exact_quantiles(df: DataFrame, by: list[str], x: str, probs: list[float], bins: int = BINS, ranked: int = RANKED) -> DataFrame:
    """(by..., p, q): exact quantiles with linear interpolation between order statistics.

    A histogram by magnitude tells in which bin each needed order statistic is.
    While such a bin holds more than ``ranked`` rows of several values, its rows, and no
    others, are counted again in ``bins`` bins of equal width between the bin's own
    least and greatest value; every round the span of a bin shrinks by that factor, so
    values that crowd however closely come apart after a few rounds.  Only rows of
    the last bins, ``ranked`` at most each, are ranked.  Nulls and NaN are left out."""
    rows = df.select(*by, F.col(x).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    rows = rows.withColumn("__parent", F.lit("")).withColumn("__bin", magnitude("__x").cast("string"))
    hist = _histogram(rows, by)
    n = hist.groupBy(*by).agg(F.sum("__c").alias("__n"))
    place = (F.col("__n") - 1) * F.col("p")
    sides = F.array(F.struct(F.lit("lo").alias("__side"), F.floor(place).cast("long").alias("__rank")),
                    F.struct(F.lit("hi").alias("__side"), F.least(F.floor(place) + 1, F.col("__n") - 1).cast("long").alias("__rank")))
    need = (n.select(*by, "__n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
            .select(*by, F.lit("").alias("__parent"), "p", (place - F.floor(place)).alias("__frac"), F.inline(sides)))
    picked = []
    while True:
        located = _locate(hist, need, by)
        crowded = (F.col("__c") > ranked) & (F.col("__lo") < F.col("__hi"))
        picked.append(_pick(rows, located.where(~crowded), by))
        if located.where(crowded).isEmpty():
            break
        split = located.where(crowded).select(*by, "__bin", "__lo", "__hi").distinct()
        width = F.col("__hi") / 2 - F.col("__lo") / 2  # halves: the difference of two doubles may be over the greatest double
        part = F.when(width > 0, F.least(F.floor((F.col("__x") / 2 - F.col("__lo") / 2) / width * bins), F.lit(bins - 1))).otherwise((F.col("__x") > F.col("__lo")).cast("long"))
        rows = rows.drop("__parent").join(split, [*by, "__bin"]).select(
            *by, "__x", F.col("__bin").alias("__parent"), F.concat_ws(".", "__bin", part.cast("string")).alias("__bin"))
        need = located.where(crowded).select(*by, F.col("__bin").alias("__parent"), "p", "__frac", "__side", "__rank")
        hist = _histogram(rows, by)
    found = picked[0]
    for more in picked[1:]:
        found = found.unionByName(more)
    g = found.groupBy(*by, "p").agg(F.max(F.when(F.col("__side") == "lo", F.col("__x"))).alias("__a"),
                                    F.max(F.when(F.col("__side") == "hi", F.col("__x"))).alias("__b"), F.first("__frac").alias("__frac"))
    return g.select(*by, "p", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__frac")).alias("q"))


def _pick(rows: DataFrame, located: DataFrame, by: list[str]) -> DataFrame:
    """The values at the located ranks: the bin's only value, or that of the rank among its counted values."""
    keep = [*by, "p", "__frac", "__side"]
    alike = located.where("__lo = __hi").select(*keep, F.col("__lo").alias("__x"))
    several = located.where("__lo < __hi")
    values = rows.select(*by, "__bin", "__x").join(several.select(*by, "__bin").distinct(), [*by, "__bin"]).groupBy(*by, "__bin", "__x").agg(F.count(F.lit(1)).alias("__vc"))
    w = Window.partitionBy(*by, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("__vend", F.sum("__vc").over(w))
    at = (F.col("__rank") < F.col("__vend")) & (F.col("__rank") >= F.col("__vend") - F.col("__vc"))
    return alike.unionByName(several.join(values, [*by, "__bin"]).where(at).select(*keep, "__x"))


def value_ranks(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by..., __x, __c, __first, __n): every distinct value with its count, the rank of its
    first copy (from 1) and the size of its group.

    Values are counted before they are shuffled, dealt out by ranges of (group,
    value), summed up within each part and shifted by the totals of the
    group's earlier parts.  Nulls and NaN are left out."""
    counted = (df.select(*by, F.col(x).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
               .groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c")))
    parts = materialize(counted.repartitionByRange(*by, "__x").withColumn("__part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy(*by, "__part").agg(F.sum("__c").alias("__t"))
    w = Window.partitionBy(*by).orderBy("__part")
    totals = (totals.withColumn("__before", F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t"))
              .withColumn("__n", F.sum("__t").over(Window.partitionBy(*by))).drop("__t"))
    within = Window.partitionBy(*by, "__part").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumn("__upto", F.sum("__c").over(within)).join(totals, [*by, "__part"])
    return ranked.select(*by, "__x", "__c", (F.col("__before") + F.col("__upto") - F.col("__c") + 1).alias("__first"), "__n")


def ranks(values: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """A row for each rank of ``value_ranks``: (by..., __x, __n, __r).  A value of many copies is dealt out in chunks of ranks."""
    begun = values.withColumn("__from", F.explode(F.sequence("__first", F.col("__first") + F.col("__c") - 1, F.lit(chunk).cast("long"))))
    begun = begun.withColumn("__to", F.least(F.col("__from") + chunk - 1, F.col("__first") + F.col("__c") - 1)).repartition(*by, "__from")
    return begun.select(*by, "__x", "__n", F.explode(F.sequence("__from", "__to")).alias("__r"))

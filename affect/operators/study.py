"""Experiment statistics (survey X1-X18) over a results table
(architecture, encoder, emotion, precision, recall, f1_score, support).

Design: the raw table is scanned into sufficient statistics (count, mean,
squared deviations — partially aggregated before the shuffle) that merge over
any coarser grouping; tests, ranks and factor means are arithmetic on a few dozen
rows.  What needs order (medians for Levene, quartiles for box plots, the
scores of Shapiro and Wilk) comes from :mod:`affect.operators.order`, which never
sorts a group in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affect.functions.stats import f_sf, norm_ppf, norm_sf, poly, t_two_sided_p
from affect.operators.order import exact_quantiles, magnitude, ranks, value_ranks  # noqa: F401
from affect.session import materialize

METRIC = "f1_score"
GROUP = ["architecture", "encoder"]
METRICS = ("precision", "recall", METRIC)
PAIRS = (("precision", "recall"), ("precision", METRIC), ("recall", METRIC))


# ---------------------------------------------------------------- cells
def moment_cells(df: DataFrame, by=(*GROUP, "emotion"), f1: str = METRIC) -> DataFrame:
    """One row per (architecture, encoder, emotion): count, mean, sum of squared
    deviations and extremes of every metric, of every pair of metrics the same over
    rows that have both and the co-moment, and the sums of F1 by support.

    The one pass over the results from which X1, X2, X5-X9, X13, X14 and X17 follow
    for any coarser grouping (:func:`merge_moments`, :func:`merge_comoments`)."""
    aggs = [F.sum(F.col(f1) * F.col("support")).alias("wf"), F.sum("support").alias("w")]
    for m in METRICS:
        aggs += [F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"mean_{m}"), (F.var_pop(m) * F.count(m)).alias(f"m2_{m}")]
    for a, b in PAIRS:
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        k = f"{a}_{b}"
        aggs += [F.count(x).alias(f"n_{k}"), F.avg(x).alias(f"x_{k}"), F.avg(y).alias(f"y_{k}"), (F.var_pop(x) * F.count(x)).alias(f"xx_{k}"),
                 (F.var_pop(y) * F.count(y)).alias(f"yy_{k}"), (F.covar_pop(x, y) * F.count(x)).alias(f"xy_{k}")]
    return df.groupBy(*by).agg(*aggs)


def _with_totals(cells: DataFrame, by: list[str], n: str, means: list[str]) -> DataFrame:
    """Cells that have any rows, with the count and the means of the group that they are merged into."""
    cells = cells.where(F.col(n) > 0)
    total = cells.groupBy(*by).agg(F.sum(n).alias("__n"), *[(F.sum(F.col(n) * F.col(m)) / F.sum(n)).alias(f"__{m}") for m in means])
    return cells.join(total, by) if by else cells.crossJoin(total)  # one row


def merge_moments(cells: DataFrame, by: list[str], metric: str = METRIC) -> DataFrame:
    """(by..., n, mean, var, var_pop) of a metric, merged from its cells: squared deviations
    add up, with those of the cells' means from the merged mean."""
    n, mean, m2 = f"n_{metric}", f"mean_{metric}", f"m2_{metric}"
    t = _with_totals(cells, by, n, [mean])
    far = F.col(mean) - F.col(f"__{mean}")
    g = t.groupBy(*by, F.col("__n").alias("n"), F.col(f"__{mean}").alias("mean")).agg(F.sum(F.col(m2) + F.col(n) * far * far).alias("__m2"))
    return g.select(*by, "n", "mean", F.when(F.col("n") > 1, F.col("__m2") / (F.col("n") - 1)).alias("var"), (F.col("__m2") / F.col("n")).alias("var_pop"))


def merge_comoments(cells: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation of two metrics over all cells."""
    k = f"{a}_{b}"
    t = _with_totals(cells, [], f"n_{k}", [f"x_{k}", f"y_{k}"])
    n, dx, dy = F.col(f"n_{k}"), F.col(f"x_{k}") - F.col(f"__x_{k}"), F.col(f"y_{k}") - F.col(f"__y_{k}")
    g = t.agg(F.sum(F.col(f"xy_{k}") + n * dx * dy).alias("xy"), F.sum(F.col(f"xx_{k}") + n * dx * dx).alias("xx"), F.sum(F.col(f"yy_{k}") + n * dy * dy).alias("yy"))
    return g.select(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("corr"))


def aggregate_cells(cells: DataFrame, by=GROUP) -> DataFrame:
    """X1 from cells."""
    by = list(by)
    mean = {m: F.sum(F.col(f"n_{m}") * F.col(f"mean_{m}")) / F.sum(f"n_{m}") for m in ("precision", "recall")}
    sums = cells.groupBy(*by).agg((F.sum("wf") / F.sum("w")).alias("weighted_f1"), mean["precision"].alias("mean_precision"),
                                  mean["recall"].alias("mean_recall"), F.sum("w").alias("total_support"))
    f1 = merge_moments(cells, by).select(*by, F.col("mean").alias("mean_f1"), F.sqrt("var").alias("std_f1"))
    return sums.join(f1, by, "left").select(*by, "weighted_f1", "mean_precision", "mean_recall", "mean_f1", "std_f1", "total_support")


def correlation_cells(cells: DataFrame) -> DataFrame:
    """X2 (long form) from cells."""
    rows = None
    for a, b in PAIRS:
        c = merge_comoments(cells, a, b)
        both = c.select(F.inline(F.array(F.struct("metric_a", "metric_b", "corr"), F.struct(F.col("metric_b").alias("metric_a"), F.col("metric_a").alias("metric_b"), "corr"))))
        rows = both if rows is None else rows.unionByName(both)
    same = cells.groupBy().agg(F.count(F.lit(1)).alias("__c")).select(F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric_a"))
    return rows.unionByName(same.select("metric_a", F.col("metric_a").alias("metric_b"), F.lit(1.0).alias("corr")))


# ---------------------------------------------------------------- X1
def aggregate_metrics(df: DataFrame, by=GROUP, f1: str = METRIC) -> DataFrame:
    """Per group support-weighted F1, mean precision/recall/F1, sample
    std of F1 and total support, weighted F1 descending."""
    return (df.groupBy(*by).agg(
        (F.sum(F.col(f1) * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"),
        F.avg(f1).alias("mean_f1"), F.stddev_samp(f1).alias("std_f1"),
        F.sum("support").alias("total_support"))
        .orderBy(F.desc("weighted_f1"), *by))


# ---------------------------------------------------------------- X2
def correlation_matrix(df: DataFrame, cols=("precision", "recall", METRIC)) -> DataFrame:
    """Pearson correlation of every metric pair in one aggregation,
    long form (metric_a, metric_b, corr)."""
    cols = list(cols)
    a = df.agg(*[F.corr(x, y).alias(f"{i}_{j}") for i, x in enumerate(cols) for j, y in enumerate(cols) if i < j])
    rows = []
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            v = F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}")
            rows.append(F.struct(F.lit(x).alias("metric_a"), F.lit(y).alias("metric_b"), v.cast("double").alias("corr")))
    return a.select(F.inline(F.array(*rows)))


def group_stats(df: DataFrame, by: str, x: str) -> DataFrame:
    """Sufficient statistics per group: n, mean, sample and population variance."""
    return df.where(F.col(x).isNotNull()).groupBy(by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"),
        F.var_samp(x).alias("var"), F.var_pop(x).alias("var_pop"))


def correlation_wide(corr: DataFrame, cols=("precision", "recall", METRIC)) -> DataFrame:
    """X2 as a matrix: one row and one column for each metric."""
    return (corr.groupBy(F.col("metric_a").alias("metric")).agg(*[F.max(F.when(F.col("metric_b") == c, F.col("corr"))).alias(c) for c in cols])
            .orderBy(F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("metric"))))


# ---------------------------------------------------------------- X5
def anova_from_stats(stats: DataFrame) -> DataFrame:
    """One-way ANOVA from per-group (n, mean, var): F, dof, p, significant.
    Runs on the k-row statistics table."""
    allw = Window.partitionBy()
    grand = F.sum(F.col("n") * F.col("mean")).over(allw) / F.sum("n").over(allw)
    t = (stats.withColumn("__grand", grand)
              .agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("__grand"), 2)).alias("ssb"),
                   F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw"),
                   F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k")))
    d1, d2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    f = (F.col("ssb") / d1) / (F.col("ssw") / d2)
    return (t.select(f.alias("f_statistic"), d1.cast("long").alias("df_between"), d2.cast("long").alias("df_within"))
             .withColumn("p_value", f_sf(F.col("f_statistic"), F.col("df_between"), F.col("df_within")))
             .withColumn("significant", F.col("p_value") < 0.05))


def anova(df: DataFrame, by: str, x: str = METRIC) -> DataFrame:
    """One-way ANOVA of ``x`` across the levels of ``by``."""
    return anova_from_stats(group_stats(df, by, x))


# ---------------------------------------------------------------- X4
def levene(df: DataFrame, by: str, x: str = METRIC) -> DataFrame:
    """Levene's test centred on the group median (Brown-Forsythe):
    ANOVA of |x - median_group|.  ``homogeneous`` = p > 0.05."""
    med = exact_quantiles(df, [by], x, [0.5]).select(by, F.col("q").alias("__med"))
    z = df.join(med, on=by).select(by, F.abs(F.col(x) - F.col("__med")).alias("__z"))
    r = anova_from_stats(group_stats(z, by, "__z"))
    return r.select(F.col("f_statistic").alias("statistic"), "df_between", "df_within", "p_value",
                    (F.col("p_value") > 0.05).alias("homogeneous"))


# ---------------------------------------------------------------- X6
def pairwise_t(df: DataFrame, by: str, x: str = METRIC, correction: str = "bonferroni") -> DataFrame:
    """Student t-test (pooled variance) for every pair of groups with
    group1 < group2, Cohen's d on population variances (0 when pooled is 0),
    significance at 0.05 / pairs (Bonferroni) or 0.05; ordered by p."""
    return pairwise_from_stats(group_stats(df, by, x), by, correction)


def pairwise_from_stats(s: DataFrame, by: str, correction: str = "bonferroni") -> DataFrame:
    """X6 on the k-row statistics table."""
    a = s.select(*[F.col(c).alias(f"{c}_1") for c in s.columns])
    b = s.select(*[F.col(c).alias(f"{c}_2") for c in s.columns])
    pairs = a.join(b, F.col(f"{by}_1") < F.col(f"{by}_2"))  # k*(k-1)/2 rows of a k-row table
    dof = F.col("n_1") + F.col("n_2") - 2
    sp2 = ((F.col("n_1") - 1) * F.col("var_1") + (F.col("n_2") - 1) * F.col("var_2")) / dof
    diff = F.col("mean_1") - F.col("mean_2")
    t = diff / F.sqrt(sp2 * (F.lit(1.0) / F.col("n_1") + F.lit(1.0) / F.col("n_2")))
    pooled = F.sqrt((F.col("var_pop_1") + F.col("var_pop_2")) / 2)
    d = F.when(pooled > 0, diff / pooled).otherwise(F.lit(0.0))
    out = pairs.select(F.col(f"{by}_1").alias("group_1"), F.col(f"{by}_2").alias("group_2"),
                       F.col("mean_1"), F.col("mean_2"), diff.alias("diff"), t.alias("t_statistic"),
                       dof.cast("long").alias("dof"), d.alias("cohens_d"))
    out = out.withColumn("p_value", t_two_sided_p(F.col("t_statistic"), F.col("dof")))
    n_pairs = F.count(F.lit(1)).over(Window.partitionBy())
    alpha = F.lit(0.05) / n_pairs if correction == "bonferroni" else F.lit(0.05)
    return out.withColumn("significant", F.col("p_value") < alpha).orderBy("p_value", "group_1", "group_2")


# ---------------------------------------------------------------- X3
# Royston's polynomials for the outer weights (in 1 / sqrt(n)) and for mean and deviation of
# the transformed W (in n up to 11 values, else in log n), highest power first.
OUTER = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
NEXT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
FEW_MEAN, FEW_LOG_SD, FEW_SHIFT = [-0.0006714, 0.025054, -0.39978, 0.544], [-0.0020322, 0.062767, -0.77857, 1.3822], [0.459, -2.273]
MEAN, LOG_SD = [0.0038915, -0.083751, -0.31082, -1.5861], [0.0030302, -0.082676, -0.4803]


def normality(df: DataFrame, by: str, x: str = METRIC) -> DataFrame:
    """Shapiro-Wilk W per group over all rows, with Royston's weights and p-value:
    (group, n, statistic, p_value, is_normal = p > 0.05).

    W needs every value's rank: values are counted and ranked by ranges
    (:func:`value_ranks`), and each rank's expected normal score is summed where it lies,
    so no group is sorted by one task.  Fewer than three values have no W; a group of
    one value has W = p = 1.  Above 5000 values W is exact, p is the same formula carried on."""
    values = materialize(value_ranks(df, [by], x), "value_ranks")
    n = F.col("__n").cast("double")
    means = values.groupBy(by).agg((F.sum(F.col("__x") * F.col("__c")) / F.sum("__c")).alias("__mean"))
    r = values.join(means, by).withColumn("__x", F.col("__x") - F.col("__mean"))
    last = F.col("__first") + F.col("__c") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__first") <= rank) & (last >= rank), F.col("__x")))

    whole = r.groupBy(by, "__n").agg(F.sum(F.col("__c") * F.col("__x") * F.col("__x")).alias("ss"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"),
                                     at(F.col("__n") - 1).alias("y2"), at(F.col("__n")).alias("y1"), (F.min("__x") == F.max("__x")).alias("alike"))
    scores = ranks(r.select(by, "__x", "__c", "__first", "__n"), [by]).withColumn("m", norm_ppf((F.col("__r") - 0.375) / (n + 0.25)))
    sums = scores.groupBy(by).agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("__x")).alias("mx"))
    t = whole.join(sums, by).withColumn("m1", -norm_ppf(F.lit(0.625) / (n + 0.25))).withColumn("m2", -norm_ppf(F.lit(1.625) / (n + 0.25)))
    root = F.lit(1.0) / F.sqrt(n)
    t = (t.withColumn("a1", F.when(n <= 3, F.lit(math.sqrt(0.5))).otherwise(F.col("m1") / F.sqrt("mm") + poly(root, OUTER)))
          .withColumn("a2", F.when(n > 5, F.col("m2") / F.sqrt("mm") + poly(root, NEXT))))
    m1, m2, a1, a2 = (F.col(c) for c in ("m1", "m2", "a1", "a2"))
    outer = F.col("y1") - F.col("x1")
    second = F.col("y2") - F.col("x2")
    one = (F.col("mx") - m1 * outer) / F.sqrt((F.col("mm") - 2 * m1 * m1) / (1 - 2 * a1 * a1)) + a1 * outer
    two = (F.col("mx") - m1 * outer - m2 * second) / F.sqrt((F.col("mm") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * outer + a2 * second
    b = F.when(n <= 3, a1 * outer).when(n <= 5, one).otherwise(two)
    t = t.withColumn("statistic", F.when(n < 3, F.lit(None)).when(F.col("alike"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), b * b / F.col("ss"))))
    w, y = F.col("statistic"), F.log(F.lit(1.0) - F.col("statistic"))
    few = (-F.log(poly(n, FEW_SHIFT) - y) - poly(n, FEW_MEAN)) / F.exp(poly(n, FEW_LOG_SD))
    many = (y - poly(F.log(n), MEAN)) / F.exp(poly(F.log(n), LOG_SD))
    z = F.when(n <= 11, F.when(y >= poly(n, FEW_SHIFT), F.lit(20.0)).otherwise(few)).otherwise(many)
    three = F.greatest(F.lit(0.0), (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))) * 6 / math.pi)
    p = F.when(w.isNull(), F.lit(None)).when(w >= 1, F.lit(1.0)).when(n == 3, three).otherwise(norm_sf(z))
    return t.withColumn("p_value", p).select(by, F.col("__n").alias("n"), "statistic", "p_value", F.coalesce(F.col("p_value") > 0.05, F.lit(False)).alias("is_normal"))


# ---------------------------------------------------------------- X7 / X8
def rank_combinations(agg: DataFrame, metric: str = "weighted_f1", k: int = 5, by=GROUP) -> DataFrame:
    """Rank by metric (desc, ties by keys); keep the top k and bottom k.
    Runs on the aggregated table (one row per combination)."""
    w = Window.orderBy(F.desc(metric), *by)
    r = agg.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return (r.withColumn("top", F.col("rank") <= k).withColumn("bottom", F.col("rank") > F.col("n") - k)
             .where(F.col("top") | F.col("bottom")).drop("n").orderBy("rank"))


def best_worst(agg: DataFrame, metric: str = "weighted_f1", by=GROUP) -> DataFrame:
    """Best and worst combination, their values, difference and %."""
    best_key = F.struct(F.col(metric), *[F.col(c) for c in by])
    worst_key = F.struct(-F.col(metric), *[F.col(c) for c in by])
    label = F.concat_ws(" + ", *[F.col(c) for c in by])
    g = agg.agg(F.max_by(label, best_key).alias("best"), F.max(metric).alias("best_value"),
                F.max_by(label, worst_key).alias("worst"), F.min(metric).alias("worst_value"))
    return (g.withColumn("difference", F.col("best_value") - F.col("worst_value"))
             .withColumn("difference_pct", F.col("difference") / F.col("worst_value") * 100))


# ---------------------------------------------------------------- X9 / X13
def factor_means(agg: DataFrame, metric: str = "weighted_f1", factors=GROUP) -> DataFrame:
    """Mean, sample std and count of the metric per level of each factor
    (one aggregation by grouping sets), mean descending within a factor."""
    factors = list(factors)
    g = agg.groupingSets([[f] for f in factors], *factors).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("count"), F.grouping_id().alias("__g"))
    # the bit of the factor that a row is of is the one that is not set
    of = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    at = F.lit(1)
    for i in range(len(factors)):
        at = F.when(F.col("__g").bitwiseAND(1 << (len(factors) - 1 - i)) == 0, F.lit(i + 1)).otherwise(at)
    return g.select(F.element_at(of, at).alias("__f"), "mean", "std", "count").select("__f.factor", "__f.level", "mean", "std", "count").orderBy("factor", F.desc("mean"), "level")


def metric_means(agg: DataFrame, factor: str) -> DataFrame:
    """Mean precision, recall and weighted F1 per factor level."""
    return agg.groupBy(factor).agg(F.avg("mean_precision").alias("mean_precision"),
                                   F.avg("mean_recall").alias("mean_recall"),
                                   F.avg("weighted_f1").alias("weighted_f1")).orderBy(factor)


# ---------------------------------------------------------------- X10
def with_group_score(df: DataFrame, agg: DataFrame, by=GROUP) -> DataFrame:
    """Attach the group's weighted F1 to every result row — an inner
    equi-join whose right side has one row per (architecture, encoder)
    combination; Spark broadcasts it if it is small."""
    return df.join(agg.select(*by, "weighted_f1"), on=list(by), how="inner")


# ---------------------------------------------------------------- X11 / X14
def per_class(df: DataFrame, x: str = METRIC, id_col: str = "run_id") -> DataFrame:
    """X11: per class the best run (first maximum of F1 = lowest id among
    ties) with its precision/recall, and mean/std/min/max of F1."""
    order = F.struct(F.col(x), -F.col(id_col))
    best = F.struct(F.col("architecture"), F.col("encoder"), F.col(x).alias("f1"),
                    F.col("precision"), F.col("recall"), F.col(id_col).alias("run_id"))
    g = df.groupBy("emotion").agg(F.max_by(best, order).alias("b"), F.avg(x).alias("mean_f1"),
                                  F.stddev_samp(x).alias("std_f1"), F.min(x).alias("min_f1"), F.max(x).alias("max_f1"))
    return g.select("emotion", F.col("b.architecture").alias("best_architecture"),
                    F.col("b.encoder").alias("best_encoder"), F.col("b.run_id").alias("best_run_id"),
                    F.col("b.f1").alias("best_f1"), F.col("b.precision").alias("best_precision"),
                    F.col("b.recall").alias("best_recall"), "mean_f1", "std_f1", "min_f1", "max_f1")


def class_bands(df: DataFrame, x: str = METRIC) -> DataFrame:
    """Mean F1 per class (descending) with band >0.8 / >0.6 / else."""
    return bands(df.groupBy("emotion").agg(F.avg(x).alias("mean_f1")))


def bands(g: DataFrame) -> DataFrame:
    """X14 on the table of means."""
    return (g.withColumn("band", F.when(F.col("mean_f1") > 0.8, "high").when(F.col("mean_f1") > 0.6, "medium")
                         .otherwise("low")).orderBy(F.desc("mean_f1"), "emotion"))


# ---------------------------------------------------------------- X12
def pivot_scores(agg: DataFrame, encoders: list[str] | None = None, metric: str = "weighted_f1") -> DataFrame:
    """Architecture x encoder matrix.  A wide table has the columns that are
    named; without names every encoder is an entry of a map column ``scores``, so
    that no level is lost and none needs to be known."""
    g = agg.groupBy("architecture")
    if encoders is not None:
        return g.pivot("encoder", encoders).agg(F.first(metric)).orderBy("architecture")
    entries = F.array_sort(F.collect_list(F.struct("encoder", F.col(metric).alias("score"))))  # a row for each encoder
    return g.agg(F.map_from_entries(entries).alias("scores")).orderBy("architecture")


# ---------------------------------------------------------------- X15 / X16
def histogram(df: DataFrame, by: str = "architecture", x: str = METRIC, bins: int = 20) -> DataFrame:
    """Equal-width histogram per group over that group's own range,
    last bin closed; every bin is listed (zero counts included)."""
    rng = df.groupBy(by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    j = df.select(by, x).where(F.col(x).isNotNull()).join(rng, on=by)
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(x) - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    cnt = j.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(by, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(cnt, on=[by, "bin"], how="left").na.fill(0, ["count"])
    return out.select(by, "bin", (F.col("__lo") + width * F.col("bin")).alias("lower"),
                      (F.col("__lo") + width * (F.col("bin") + 1)).alias("upper"), "count").orderBy(by, "bin")


def box_stats(df: DataFrame, by: str, x: str = METRIC) -> DataFrame:
    """Quartiles (linear), IQR, whiskers = furthest data within
    1.5 IQR of the box, and the number of outliers, per group."""
    q = exact_quantiles(df, [by], x, [0.25, 0.5, 0.75])
    qs = q.groupBy(by).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                             for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]])
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.select(by, x).join(qs, on=by)
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    g = j.groupBy(by).agg(F.min(F.when(F.col(x) >= lo, F.col(x))).alias("whisker_low"),
                          F.max(F.when(F.col(x) <= hi, F.col(x))).alias("whisker_high"),
                          F.count_if((F.col(x) < lo) | (F.col(x) > hi)).alias("outliers"))
    return qs.join(g, on=by).orderBy(by)


# ---------------------------------------------------------------- X17 / X18
def conclusions(agg: DataFrame, factors: DataFrame, corr: DataFrame) -> DataFrame:
    """(pos, item, value, score) rows: best / worst combination, best
    architecture and encoder, three correlations, then the full ranking."""
    bw = best_worst(agg)
    rows = [bw.select(F.lit(1).alias("pos"), F.lit("best_combination").alias("item"),
                      F.col("best").alias("value"), F.col("best_value").alias("score")),
            bw.select(F.lit(2), F.lit("worst_combination"), F.col("worst"), F.col("worst_value")),
            bw.select(F.lit(3), F.lit("difference"), F.lit(None).cast("string"), F.col("difference"))]
    for pos, f in [(4, "architecture"), (5, "encoder")]:
        rows.append(factors.where(F.col("factor") == f).agg(
            F.min_by(F.col("level"), F.struct(-F.col("mean"), F.col("level"))).alias("value"),
            F.max("mean").alias("score")).select(F.lit(pos), F.lit(f"best_{f}"), "value", "score"))
    for pos, (a, b) in [(6, ("precision", "recall")), (7, ("precision", METRIC)), (8, ("recall", METRIC))]:
        rows.append(corr.where((F.col("metric_a") == a) & (F.col("metric_b") == b))
                    .select(F.lit(pos), F.lit(f"corr_{a}_{b}"), F.lit(None).cast("string"), F.col("corr")))
    w = Window.orderBy(F.desc("weighted_f1"), "architecture", "encoder")
    rows.append(agg.select((F.lit(100) + F.row_number().over(w)).alias("pos"), F.lit("rank"),
                           F.concat_ws(" + ", "architecture", "encoder"), F.col("weighted_f1")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.orderBy("pos")


#: The study's tables: the key columns of each (its other columns are what it measures).
STUDY = {
    "aggregate": GROUP, "correlation": ["metric_a", "metric_b"], "normality_architecture": ["architecture"], "normality_encoder": ["encoder"],
    "levene_architecture": [], "levene_encoder": [], "anova_architecture": [], "anova_encoder": [],
    "pairwise_architecture": ["group_1", "group_2"], "pairwise_encoder": ["group_1", "group_2"], "ranking": GROUP, "best_worst": [],
    "factors": ["factor", "level"], "per_class": ["emotion"], "pivot": GROUP, "metric_means_architecture": ["architecture"],
    "metric_means_encoder": ["encoder"], "class_bands": ["emotion"], "histogram": ["architecture", "bin"],
    "box_architecture": ["architecture"], "box_encoder": ["encoder"], "conclusions": ["pos", "item"],
}


def run_study(df: DataFrame) -> dict[str, DataFrame]:
    """The tables of the complete study.  Moment cells are taken in one pass, written, and serve
    every table that moments decide (aggregate, correlation, analyses of variance, pairwise tests, ranking,
    best and worst, factors, pivot, metric means, bands, conclusions); normality, medians, quartiles,
    histograms and the best run of a class need values and read the results themselves."""
    cells = materialize(moment_cells(df), "cells")
    agg = materialize(aggregate_cells(cells), "aggregate")
    corr, fac = correlation_cells(cells), factor_means(agg)
    out = {"aggregate": agg, "correlation": corr, "ranking": rank_combinations(agg), "best_worst": best_worst(agg), "factors": fac,
           "per_class": per_class(df), "pivot": agg.select(*GROUP, "weighted_f1"),
           "class_bands": bands(merge_moments(cells, ["emotion"]).select("emotion", F.col("mean").alias("mean_f1"))), "histogram": histogram(df)}
    for f in GROUP:
        stats = merge_moments(cells, [f])
        out |= {f"normality_{f}": normality(df, f), f"levene_{f}": levene(df, f), f"anova_{f}": anova_from_stats(stats),
                f"pairwise_{f}": pairwise_from_stats(stats, f), f"metric_means_{f}": metric_means(agg, f), f"box_{f}": box_stats(df, f)}
    out["conclusions"] = conclusions(agg, fac, corr)
    return {name: out[name] for name in STUDY}


def study(df: DataFrame) -> DataFrame:
    """X18 in one long table: (table, key, metric, value, text), a row for each measure of each row of every
    table; truth values are 1 and 0."""
    rows = None
    for name, frame in run_study(df).items():
        measures = [F.struct(F.lit(c).alias("metric"), (F.lit(None) if t == "string" else F.col(c)).cast("double").alias("value"),
                             (F.col(c) if t == "string" else F.lit(None)).cast("string").alias("text")) for c, t in frame.dtypes if c not in STUDY[name]]
        key = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in STUDY[name]])
        part = frame.select(F.lit(name).alias("table"), key.alias("key"), F.inline(F.array(*measures)))
        rows = part if rows is None else rows.unionByName(part)
    return rows

"""Corpus profile aggregations (survey A1-A18).

Each operator is one scan of the (already normalised) corpus followed by a
hash aggregate with map-side partial aggregation; results are small (bounded
by the number of labels / label combinations), so the final ordering and the
``over ()`` windows run on a few hundred rows only.

Percentages are of all utterances (reference behaviour) and rounded
half-to-even (``bround``), like ``numpy.round``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affect.functions.clean import finite, py_strip, to_num
from affect.functions.frames import stack_rows
from affect.operators.labels import MOST_COLUMNS, SLOTS, with_emotions


def _all():
    """Global window; only ever used on small aggregated results."""
    return Window.partitionBy()


def _pct(count_col, total_col, digits: int = 2):
    return F.bround(F.col(count_col) / F.col(total_col) * 100, digits)


def _with_marker_total(exploded: DataFrame, key: str, count_name: str) -> DataFrame:
    """Count ``key`` values where every source row also emitted one marker
    row (key null).  The marker group's count is the row total N, so the
    percentage needs no second scan and no join."""
    agg = exploded.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    return (agg.withColumn("__n", F.max(F.when(F.col(key).isNull(), F.col(count_name))).over(_all()))
               .where(F.col(key).isNotNull()))


# ---------------------------------------------------------------- A1
def num_emotions_table(df: DataFrame) -> DataFrame:
    """A1: histogram of emotions per utterance with % of N."""
    e = df if "num_emotions" in df.columns else with_emotions(df)
    agg = e.groupBy("num_emotions").agg(F.count(F.lit(1)).alias("count"))
    return (agg.withColumn("percentage", F.bround(F.col("count") / F.sum("count").over(_all()) * 100, 2))
               .orderBy("num_emotions"))


# ---------------------------------------------------------------- A2
def multilabel_summary(df: DataFrame) -> DataFrame:
    """A2: five rows — total, 0, 1, >=2 and 3 emotions — with % of N."""
    e = df if "num_emotions" in df.columns else with_emotions(df)
    n = F.col("num_emotions")
    one = e.agg(F.count(F.lit(1)).alias("t"), F.count_if(n == 0).alias("z"),
                F.count_if(n == 1).alias("o"), F.count_if(n >= 2).alias("m"),
                F.count_if(n == 3).alias("th"))
    rows = one.select(F.col("t").alias("__n"), F.inline(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("Total utterances").alias("metric"), F.col("t").alias("value")),
        *[F.struct(F.lit(p).alias("pos"), F.lit(m).alias("metric"), F.col(c).alias("value"))
          for p, m, c in [(2, "Neutral only (0 emotions)", "z"), (3, "Single emotion", "o"),
                          (4, "Multilabel (≥2 emotions)", "m"), (5, "Three emotions", "th")]])))
    return rows.select("pos", "metric", "value", _pct("value", "__n").alias("percentage")).orderBy("pos")


# ---------------------------------------------------------------- A3
def emotion_pairs(df: DataFrame) -> DataFrame:
    """A3: co-occurring pairs = combinations(sorted(emotions), 2) per utterance
    (a multiset: a duplicated label gives ``a + a``), counted over all
    utterances, % of N, count descending.

    Pairs come from higher-order functions over the (<= 3 element) sorted
    array — no self-join; each utterance also emits one marker row so the
    total N arrives in the same aggregation.
    """
    e = df if "emotions" in df.columns else with_emotions(df)
    s = F.array_sort(F.col("emotions"))
    k = F.size(s)
    pairs = F.when(k >= 2, F.flatten(F.transform(
        F.sequence(F.lit(0), k - 2),
        lambda i: F.transform(F.sequence(i + 1, k - 1),
                              lambda j: F.concat(F.get(s, i), F.lit(" + "), F.get(s, j))))
    )).otherwise(F.array().cast("array<string>"))
    exploded = e.select(F.explode(F.concat(pairs, F.array(F.lit(None).cast("string")))).alias("emotion_pair"))
    agg = _with_marker_total(exploded, "emotion_pair", "count")
    return (agg.select("emotion_pair", "count", _pct("count", "__n").alias("percentage"))
               .orderBy(F.desc("count"), "emotion_pair"))


# ---------------------------------------------------------------- A4
def sentiment_multilabel(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """A4: per sentiment, mean number of emotions and % with >= 2 (2 dp);
    null sentiment dropped (pandas ``groupby`` semantics)."""
    e = df if "num_emotions" in df.columns else with_emotions(df)
    return (e.where(F.col(sentiment).isNotNull())
             .groupBy(sentiment)
             .agg(F.bround(F.avg("num_emotions"), 2).alias("avg_num_emotions"),
                  F.bround(F.avg(F.when(F.col("num_emotions") >= 2, 1.0).otherwise(0.0)) * 100, 2)
                  .alias("multilabel_percentage"))
             .orderBy(sentiment))


# ---------------------------------------------------------------- A5 / A6
def mean_intensity(df: DataFrame) -> DataFrame:
    """A5: row mean of the numeric intensities (slots count even when their
    label was rejected); null when none is numeric."""
    vals = F.filter(F.array(*[to_num(i) for _, i in SLOTS]), lambda x: x.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("mean_intensity", F.when(F.size(vals) > 0, total / F.size(vals)))


def intensity_by_cardinality(df: DataFrame) -> DataFrame:
    """Per number of emotions, avg / max / non-null count of A5."""
    e = df if "num_emotions" in df.columns else with_emotions(df)
    e = mean_intensity(e)
    return (e.groupBy("num_emotions")
             .agg(F.bround(F.avg("mean_intensity"), 2).alias("avg_intensity"),
                  F.bround(F.max("mean_intensity"), 2).alias("max_intensity"),
                  F.count("mean_intensity").alias("count"))
             .orderBy("num_emotions"))


# ---------------------------------------------------------------- A7
def emotion_frequency(df: DataFrame) -> DataFrame:
    """Label mentions (duplicates count twice); % of all utterances."""
    e = df if "emotions" in df.columns else with_emotions(df)
    exploded = e.select(F.explode(F.concat(F.col("emotions"), F.array(F.lit(None).cast("string"))))
                        .alias("emotion"))
    agg = _with_marker_total(exploded, "emotion", "frequency")
    return (agg.select("emotion", "frequency", _pct("frequency", "__n").alias("percentage"))
               .orderBy(F.desc("frequency"), "emotion"))


# ---------------------------------------------------------------- A8
def sentiment_distribution(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """Value counts of the sentiment column (nulls dropped)."""
    return (df.where(F.col(sentiment).isNotNull()).groupBy(sentiment)
              .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), sentiment))


def sentiment_bincount(df: DataFrame, code: str = "sentiment_code") -> DataFrame:
    """A8 class-code form: counts of codes 0..2 (missing codes -> 0)."""
    return df.agg(*[F.count_if(F.col(code) == k).alias(f"class_{k}") for k in range(3)])


# ---------------------------------------------------------------- A9
def emotion_presence(df: DataFrame) -> DataFrame:
    """Presence per *raw* (case-sensitive, unstripped) label summed over
    the slots, descending."""
    raw = df.select(F.explode(F.array(*[F.col(e) for e, _ in SLOTS])).alias("emotion"))
    return (raw.where(F.col("emotion").isNotNull() & (F.col("emotion") != ""))
               .groupBy("emotion").agg(F.count(F.lit(1)).alias("count"))
               .orderBy(F.desc("count"), "emotion"))


# ---------------------------------------------------------------- A10
def multi_emotion_ratio(df: DataFrame) -> DataFrame:
    """A10: average non-null emotion cells per row and % of rows with > 1."""
    n = sum(F.when(F.col(e).isNotNull(), 1).otherwise(0) for e, _ in SLOTS)
    return df.agg(F.avg(n).alias("avg_emotions"),
                  (F.avg(F.when(n > 1, 1.0).otherwise(0.0)) * 100).alias("multi_percentage"))


# ---------------------------------------------------------------- A11
def emotion_intensity_long(df: DataFrame) -> DataFrame:
    """Raw label x truncated intensity mention counts (long form)."""
    recs = df.select(F.inline(F.array(*[
        F.struct(F.col(e).alias("emotion"), finite(i).cast("int").alias("intensity"))
        for e, i in SLOTS])))
    return (recs.where(F.col("emotion").isNotNull() & (F.col("emotion") != "") & F.col("intensity").isNotNull())
                .groupBy("intensity", "emotion").agg(F.count(F.lit(1)).alias("count")))


def emotion_intensity_crosstab(df: DataFrame, vocab: list[str] | None = None) -> DataFrame:
    """Intensity rows x raw-emotion columns, missing cells 0.  ``vocab``
    fixes the column set (else it is read from the data, ``MOST_COLUMNS`` at most); the long form has every label."""
    long = emotion_intensity_long(df)
    if vocab is None:
        vocab = sorted(r[0] for r in long.select("emotion").distinct().limit(MOST_COLUMNS + 1).collect())
        if len(vocab) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} labels: no wide table (see emotion_intensity_long)")
    return (long.groupBy("intensity").pivot("emotion", vocab).agg(F.sum("count"))
                .na.fill(0, subset=vocab).orderBy("intensity"))


# ---------------------------------------------------------------- A12
def intensity_counts(df: DataFrame) -> DataFrame:
    """Counts of truncated intensity values over all slots, key order."""
    vals = df.select(F.explode(F.array(*[finite(i).cast("int") for _, i in SLOTS])).alias("intensity"))
    return (vals.where(F.col("intensity").isNotNull()).groupBy("intensity")
                .agg(F.count(F.lit(1)).alias("count")).orderBy("intensity"))


# ---------------------------------------------------------------- A13 / A14
def balance_report(df: DataFrame, keep_null_label: bool = False) -> DataFrame:
    """Count per (emotion1, intensity1), ``needed_to_balance`` = max - count,
    count descending.  ``keep_null_label`` reproduces the 'nan' label group."""
    label = F.lower(py_strip(F.col("emotion1").cast("string")))
    if keep_null_label:
        label = F.coalesce(label, F.lit("nan"))
    g = (df.select(label.alias("emotion1"), to_num("intensity1").alias("intensity1"))
           .where(F.col("emotion1").isNotNull() & F.col("intensity1").isNotNull())
           .groupBy("emotion1", "intensity1").agg(F.count(F.lit(1)).alias("count")))
    return (g.withColumn("needed_to_balance", F.max("count").over(_all()) - F.col("count"))
             .orderBy(F.desc("count"), "emotion1", "intensity1"))


def balance_summary(df: DataFrame, report: DataFrame | None = None,
                    expand_percent: int = 70) -> DataFrame:
    """N, combinations, max per group, needed, recommended parameters."""
    report = report if report is not None else balance_report(df)
    n = df.agg(F.count(F.lit(1)).alias("total_original_samples"))
    r = report.agg(F.count(F.lit(1)).alias("unique_combinations"),
                   F.max("count").alias("max_per_group"),
                   F.sum("needed_to_balance").alias("needed_to_balance"))
    # Two single-row aggregates merged by a union + max (no join needed).
    one = n.unionByName(r, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("total_original_samples", "unique_combinations",
                                      "max_per_group", "needed_to_balance")])
    return (one.withColumn("recommended_num_samples", F.col("needed_to_balance"))
             .withColumn("recommended_expand_percent", F.lit(expand_percent)))


# ---------------------------------------------------------------- A15-A17 (one-hot input)
def _n_emotions(vocab, prefix="em__"):
    return sum(F.col(f"{prefix}{e}") for e in vocab)


def cooccurrence_stats(parsed: DataFrame, vocab: list[str], prefix: str = "em__") -> DataFrame:
    """Rows with exactly 1, 2 and >= 3 emotions present, with %."""
    n = _n_emotions(vocab, prefix)
    a = parsed.agg(F.count(F.lit(1)).alias("n"), F.count_if(n == 1).alias("one_emotion"),
                   F.count_if(n == 2).alias("two_emotions"), F.count_if(n >= 3).alias("three_plus"))
    return a.select("one_emotion", "two_emotions", "three_plus",
                    *[F.round(F.col(c) / F.col("n") * 100, 6).alias(f"{c}_pct")
                      for c in ("one_emotion", "two_emotions", "three_plus")])


def avg_intensity(parsed: DataFrame, vocab: list[str], prefix: str = "int__") -> DataFrame:
    """Mean intensity class per emotion over *all* rows, plus the overall
    mean over the non-zero classes (0 when there is none)."""
    cells = F.array(*[F.col(f"{prefix}{e}") for e in vocab])
    nz = F.filter(cells, lambda x: x > 0)
    per = [F.avg(F.col(f"{prefix}{e}")).alias(e) for e in vocab]
    a = parsed.agg(*per, F.sum(F.aggregate(nz, F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("__s"),
                   F.sum(F.size(nz)).alias("__c"))
    rows = a.select(stack_rows(["emotion", "avg_intensity"],
                               [(e, F.col(e).cast("double")) for e in vocab]
                               + [("__overall__", F.coalesce(F.col("__s") / F.col("__c"), F.lit(0.0)))]))
    return rows.select("emotion", F.round("avg_intensity", 6).alias("avg_intensity"))


def presence_rates(parsed: DataFrame, vocab: list[str], prefix: str = "em__") -> DataFrame:
    """Presence count and % per emotion."""
    a = parsed.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(f"{prefix}{e}")).alias(e) for e in vocab])
    rows = a.select("__n", F.inline(F.array(*[
        F.struct(F.lit(e).alias("emotion"), F.col(e).cast("bigint").alias("present")) for e in vocab])))
    return rows.select("emotion", "present", F.round(F.col("present") / F.col("__n") * 100, 6).alias("present_pct"))


# ---------------------------------------------------------------- A18
def head(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """A18's head: the first ``n`` rows by ``order``, then by all other columns (a table has no order of its own).  Every task keeps n rows."""
    return df.orderBy(*order, *[c for c in df.columns if c not in order]).limit(n)


def profile(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Long-form table profile — row/column counts, nulls per column and
    ``describe`` statistics (count, mean, std, min, exact quartiles with
    linear interpolation, max) per numeric column.

    Moments come from one aggregation pass.  Quartiles are exact: the numeric
    columns are unpivoted to (column, value) and selected by refined histograms
    (:func:`exact_quantiles`), all columns in the same rounds."""
    from affect.operators.order import exact_quantiles
    numeric = numeric if numeric is not None else [
        f.name for f in df.schema.fields
        if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null__{c}") for c in df.columns]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"),
                 F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
    a = df.agg(*aggs)
    rows = [("__table__", "rows", F.col("__rows").cast("double")),
            ("__table__", "columns", float(len(df.columns)))]
    rows += [(c, "nulls", F.col(f"null__{c}").cast("double")) for c in df.columns]
    for c in numeric:
        rows += [(c, "count", F.col(f"count__{c}").cast("double")), (c, "mean", F.col(f"mean__{c}")),
                 (c, "std", F.col(f"std__{c}")), (c, "min", F.col(f"min__{c}")), (c, "max", F.col(f"max__{c}"))]
    moments = a.select(stack_rows(["column", "statistic", "value"], rows))
    if numeric:
        long = df.select(stack_rows(["column", "value"], [(c, F.col(c).cast("double")) for c in numeric]))
        q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
        q = q.select("column", F.concat((F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
                     F.col("q").alias("value"))
        moments = moments.unionByName(q)
    return moments.select("column", "statistic", F.round("value", 6).alias("value"))

"""Label-table preparation (survey S8, M0-M3): validate a one-hot corpus,
parse it into typed label arrays, split it stratified, derive class and
label weights.

Everything is a column pipeline (no UDF); the only aggregates are global
counts with partial aggregation.  The emotion vocabulary comes from column
names (schema metadata), never from a collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affect.functions.clean import (TRUE_WORDS, finite, py_int, py_strip,
                                    repair_text, sentiment_code)
from affect.operators.sampling import draw_long, lowest_by_draw
from affect.operators.labels import parse_one_hot

TEXT_KEYS_LOADER = ["utterance", "text", "message", "content", "augmented"]
FALSE_WORDS = ["0", "0.0", "false", "f", "no", "n", ""]


def strip_columns(df: DataFrame) -> DataFrame:
    """Header names stripped of surrounding whitespace."""
    return df.toDF(*[c.strip() for c in df.columns])


def resolve_text_column(columns: list[str], keys=TEXT_KEYS_LOADER, fallback=None) -> str | None:
    """First column whose lower-cased name contains one of ``keys``; else
    ``fallback`` (a column name, ``'first'`` for the first column, or None)."""
    for c in columns:
        if any(k in c.lower() for k in keys):
            return c
    if fallback == "first":
        return columns[0] if columns else None
    return fallback


def emotion_names(df: DataFrame) -> list[str]:
    """Emotion vocabulary from ``emotion__<name>`` column names, in column order."""
    return [c.split("emotion__", 1)[1] for c in df.columns if c.startswith("emotion__")]


def schema_errors(df: DataFrame) -> list[str]:
    """S8 structural checks, all errors together (driver-side metadata only)."""
    errors = []
    if resolve_text_column(df.columns) is None:
        errors.append("No text column found")
    if "sentiment" not in df.columns:
        errors.append("Missing 'sentiment' column")
    names = emotion_names(df)
    if not names:
        errors.append("No emotion columns found (expected format: emotion__<name>)")
    for e in names:
        if f"intensity__{e}" not in df.columns:
            errors.append(f"Missing intensity column: intensity__{e}")
    return errors


def validate_one_hot(df: DataFrame) -> DataFrame:
    """S8 re-aimed as a data-quality job: one row per (column, check) with
    the number of values the parser would silently default, plus one row per
    structural error.  A single aggregation pass over all columns."""
    df = strip_columns(df)
    names = emotion_names(df)
    checks = []  # (column, check, condition)
    if "sentiment" in df.columns:
        key = F.lower(py_strip(F.col("sentiment").cast("string")))
        known = key.isin("neg", "negative", "0", "neu", "neutral", "1", "pos", "positive", "2")
        checks.append(("sentiment", "defaulted_to_neutral", ~known & finite(key).isNull()))
        checks.append(("sentiment", "clamped", ~known & finite(key).isNotNull()
                       & ((py_int(finite(key)) < 0) | (py_int(finite(key)) > 2))))
    for e in names:
        c = F.col(f"emotion__{e}")
        s = F.lower(py_strip(c.cast("string")))
        checks.append((f"emotion__{e}", "unrecognised_flag",
                       c.isNotNull() & ~s.isin(*TRUE_WORDS, *FALSE_WORDS, e.lower())))
        icol = f"intensity__{e}"
        if icol in df.columns:
            v = finite(F.col(icol).cast("string"))
            checks.append((icol, "unparsable", F.col(icol).isNotNull() & v.isNull()))
            checks.append((icol, "out_of_range", v.isNotNull() & ((py_int(v) < 1) | (py_int(v) > 3))))
    text = resolve_text_column(df.columns)
    if text is not None:
        checks.append((text, "shorter_than_5", F.length(py_strip(F.coalesce(F.col(text), F.lit("")))) < 5))
    if not checks:
        base = df.sparkSession.createDataFrame([], "column string, check string, violations bigint")
    else:
        a = df.agg(*[F.count_if(cond).alias(f"c{k}") for k, (_, _, cond) in enumerate(checks)])
        base = a.select(F.inline(F.array(*[
            F.struct(F.lit(col).alias("column"), F.lit(chk).alias("check"), F.col(f"c{k}").alias("violations"))
            for k, (col, chk, _) in enumerate(checks)])))
    errs = schema_errors(df)
    if errs:
        err_df = df.sparkSession.createDataFrame([("__schema__", m, 1) for m in errs],
                                                 "column string, check string, violations bigint")
        base = base.unionByName(err_df)
    return base


def load_labels(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """M0 composite load: S2 -> S8 -> N7 -> N4 -> N5/N6 -> L8.

    Raises ``ValueError`` listing every structural error (as the reference);
    returns (id, text, sentiment, em__*, int__*, emotion_labels,
    intensity_labels).  Rows whose text cannot be repaired are dropped.
    """
    df = strip_columns(df)
    errs = schema_errors(df)
    if errs:
        raise ValueError("CSV format validation failed:\n" + "\n".join(f"  - {e}" for e in errs))
    text = resolve_text_column(df.columns)
    names = emotion_names(df)
    df = repair_text(df, text, "original")
    df = df.withColumn("sentiment_code", sentiment_code("sentiment"))
    parsed = parse_one_hot(df, names)
    parsed = (parsed.withColumn("emotion_labels", F.array(*[F.col(f"em__{e}") for e in names]))
                    .withColumn("intensity_labels", F.array(*[F.col(f"int__{e}") for e in names])))
    keep = ([id_col] if id_col else []) + [F.col(text).alias("text"), "sentiment_code"]
    keep += [f"em__{e}" for e in names] + [f"int__{e}" for e in names] + ["emotion_labels", "intensity_labels"]
    return parsed.select(*keep)


def load_statistics(raw: DataFrame, loaded: DataFrame, names: list[str]) -> DataFrame:
    """M0 statistics in one row: loaded / skipped rows, sentiment bincount
    (A8), mean emotions per sample (A10), label mode (L9) and the
    co-occurrence counts (A15)."""
    n_em = sum(F.col(f"em__{e}") for e in names)
    a = loaded.agg(
        F.count(F.lit(1)).alias("loaded"),
        *[F.count_if(F.col("sentiment_code") == k).alias(f"sentiment_{k}") for k in range(3)],
        F.avg(n_em).alias("avg_emotions"),
        F.avg(F.when(n_em <= 1, 1.0).otherwise(0.0)).alias("single_label_ratio"),
        F.count_if(n_em == 1).alias("one_emotion"), F.count_if(n_em == 2).alias("two_emotions"),
        F.count_if(n_em >= 3).alias("three_plus"))
    total = raw.agg(F.count(F.lit(1)).alias("__raw"))
    one = a.unionByName(total, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in a.columns + ["__raw"]])
    return (one.withColumn("skipped", F.col("__raw") - F.col("loaded")).drop("__raw")
               .withColumn("mode", F.when(F.col("single_label_ratio") < 0.95, "multi-label")
                           .otherwise("single-emotion")))


# ---------------------------------------------------------------- M1
def stratified_split(df: DataFrame, by: str, id_col: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """M1: seeded split with an exact per-stratum test quota.

    Quotas follow a largest-remainder allocation of ``round(frac*N)`` over the
    strata (computed on the small per-stratum count table); membership is the
    ``quota`` lowest hash draws of each stratum, found by the skew-safe
    histogram selection of :mod:`affect.operators.sampling` (no per-stratum
    sort; the input is read twice, once without its texts).  Adds ``split`` in {'train','test'}.
    """
    def quotas(counts: DataFrame) -> DataFrame:
        allw = Window.partitionBy()
        return (counts.withColumn("__bign", F.sum("__n").over(allw))
                      .withColumn("__total_test", F.round(F.col("__bign") * frac).cast("long"))
                      .withColumn("__exact", F.col("__n") * F.col("__total_test") / F.col("__bign"))
                      .withColumn("__floor", F.floor("__exact").cast("long"))
                      .withColumn("__rem", F.col("__exact") - F.col("__floor"))
                      .withColumn("__left", F.col("__total_test") - F.sum("__floor").over(allw))
                      .withColumn("__rank", F.row_number().over(allw.orderBy(F.desc("__rem"), F.col(by))))
                      .withColumn("__quota", F.col("__floor")
                                  + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0))
                      .select(by, "__quota"))

    out = lowest_by_draw(df, [by], quotas, draw_long(seed, id_col, "split"), tie=id_col, flag="__test")
    return (out.withColumn("split", F.when(F.col("__test"), "test").otherwise("train"))
               .drop("__test", "__rank_draw"))


def plain_split(df: DataFrame, id_col: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """M1 without strata: ``round(frac * N)`` rows of the lowest draws are the test part."""
    def quota(counts: DataFrame) -> DataFrame:
        return counts.withColumn("__quota", F.round(F.col("__n") * frac).cast("long"))

    out = lowest_by_draw(df.withColumn("__all", F.lit(1)), ["__all"], quota, draw_long(seed, id_col, "split"), tie=id_col, flag="__test")
    return out.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test", "__rank_draw", "__all")


def split(df: DataFrame, by: str, id_col: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """M1 with its fallback: stratified, unless that is impossible — a stratum of one row, or fewer
    test or training rows than strata — and then plain."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("strata")).first()
    test = round(frac * (counts["n"] or 0))
    possible = counts["least"] is not None and counts["least"] > 1 and counts["strata"] <= min(test, counts["n"] - test)
    return stratified_split(df, by, id_col, frac, seed) if possible else plain_split(df, id_col, frac, seed)


# ---------------------------------------------------------------- M2 / M3
def class_weights(df: DataFrame, label: str, classes: list) -> DataFrame:
    """M2: balanced weights n / (k * count_c) over the given classes; a class
    absent from ``df`` gets 1.0."""
    spark = df.sparkSession
    k = len(classes)
    cls = spark.createDataFrame([(c,) for c in classes], f"{label} {_ddl(classes)}")
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    j = cls.join(cnt, on=label, how="left")
    return (j.withColumn("__n", F.sum("count").over(Window.partitionBy()))
             .select(label, F.coalesce(F.col("count"), F.lit(0)).alias("count"),
                     F.coalesce(F.col("__n") / (F.lit(k) * F.col("count")), F.lit(1.0)).alias("weight")))


def _ddl(values) -> str:
    return "int" if all(isinstance(v, int) for v in values) else "string"


def label_weights(parsed: DataFrame, names: list[str], prefix: str = "em__") -> DataFrame:
    """M3: inverse label frequency 1 / (freq + 1e-6) over all rows."""
    a = parsed.agg(*[F.avg(F.col(f"{prefix}{e}").cast("double")).alias(e) for e in names])
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(e).alias("emotion"), F.col(e).alias("frequency"),
                 (F.lit(1.0) / (F.col(e) + F.lit(1e-6))).alias("weight")) for e in names])))

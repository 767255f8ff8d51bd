"""Sampling, augmentation assembly and label-combination balancing
(survey D7, D14-D20).

The balance plan is computed on the per-bundle count table (one row per
label combination); down-sampling and the two expansion passes are exact
per-group selections by seeded hash draw (skew-safe histogram selection, no
group sort, see :mod:`affect.operators.sampling`).  The whole balance is one
planned job — no loop over groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affect.functions.clean import word_count
from affect.functions.draws import uniform
from affect.operators.labels import SLOTS, bundle_key, with_bundle
from affect.operators.rewrite import (gate_completion, is_valid_output, quality_score,
                                      rewrite_rules)
from affect.operators.sampling import draw_long, lowest_by_draw
from affect.session import materialize

#: Ranges of passes that one row is cut into at once, at most.
FAN = 1000


# ---------------------------------------------------------------- D7
def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42, step: str = "sample") -> DataFrame:
    """Exactly min(n, N) rows without replacement, the lowest seeded
    draws (ties by id)."""
    d = df.withColumn("__all", F.lit(1))
    quota = d.sparkSession.range(1).select(F.lit(1).alias("__all"), F.lit(int(n)).cast("long").alias("__quota"))
    return lowest_by_draw(d, ["__all"], quota, draw_long(seed, id_col, step), tie=id_col).drop("__all", "__rank_draw")


# ---------------------------------------------------------------- D14
def augment(rows: DataFrame, mode: str = "mixed", seed: int = 42, id_col: str = "utt_id",
            text_col: str = "utterance", completion_col: str | None = None,
            default_sentiment: str = "negative", mixed_share: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """D14 with D8h routing: ``rows`` carry the attached patterns.
    Modes: 'llm' uses the gated completion when a completion column is given
    (else identity), 'eda' the rules, 'mixed' the completion with probability
    ``mixed_share`` when available, otherwise the rules; any other mode is
    identity.  Invalid outputs (D12) revert to the original.  Returns
    (augmented rows, detail rows)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    b = with_bundle(rows)
    ints = F.transform("bundle", lambda x: x["intensity"].cast("int").cast("double"))
    mean_int = F.when(F.size("bundle") > 0, F.aggregate(ints, F.lit(0.0), lambda a, x: a + x) / F.size("bundle")) \
        .otherwise(F.lit(2.0))
    b = b.withColumn("__orig", text).withColumn("__mi", mean_int)
    if mode in ("eda", "mixed"):
        b = rewrite_rules(b, "__orig", "keywords", "sentence_starters", "intensifiers", "avg_length", "__mi",
                          id_col, seed, out="rw_eda")
    if completion_col and mode in ("llm", "mixed"):
        b = b.withColumn("__llm", gate_completion(F.col(completion_col), F.col("__orig")))
    llm = F.col("__llm") if completion_col else F.col("__orig")
    if mode == "llm":
        out = llm
    elif mode == "eda":
        out = F.col("rw_eda")
    elif mode == "mixed":
        out = F.when(uniform(seed, id_col, "mixed") < mixed_share, llm).otherwise(F.col("rw_eda")) \
            if completion_col else F.col("rw_eda")
    else:
        out = F.col("__orig")
    b = b.withColumn("__out", out)
    b = b.withColumn("__valid", is_valid_output(F.col("__out")))
    b = b.withColumn("augmented", F.when(F.col("__valid"), F.col("__out")).otherwise(F.col("__orig")))
    b = b.withColumn("quality", quality_score("__orig", "augmented", "avg_length", "keywords"))
    sentiment = F.coalesce(F.col("sentiment"), F.lit(default_sentiment))
    aug = b.select(F.col(id_col), sentiment.alias("sentiment"), *[F.col(c) for p in SLOTS for c in p],
                   F.col("__orig").alias("original"), "augmented", "quality", F.lit(mode).alias("mode"))
    details = b.select(F.col(id_col).alias("sample_idx"), word_count(F.col("__orig")).alias("original_len"),
                       word_count(F.col("augmented")).alias("transformed_len"),
                       F.when(F.size("bundle") == 0, F.lit("neutral:2.0"))
                        .otherwise(F.array_join(F.transform("bundle", lambda x: F.concat(
                            x["emotion"], F.lit(":"), x["intensity"].cast("string"))), ",")).alias("bundle"),
                       "quality", F.lit(mode).alias("mode"),
                       is_valid_output(F.col("augmented")).alias("is_valid"),
                       (~F.col("__valid")).alias("reverted"))
    return aug, details


# ---------------------------------------------------------------- D15
def balance_plan(df: DataFrame, multiplier: float = 1.0, cap: int | None = None) -> DataFrame:
    """Per bundle key: count, target = int(max * multiplier), action
    keep / downsample / augment, the rows it needs (all that are missing, or
    at most ``cap`` if one is given) and how they are drawn: ``full_passes``
    times the whole group and ``last_pass`` of its rows once more."""
    keyed = df if "bundle_key" in df.columns else with_bundle(df).withColumn("bundle_key", bundle_key(F.col("bundle")))
    c = keyed.groupBy("bundle_key").agg(F.count(F.lit(1)).alias("count"))
    missing = F.col("target") - F.col("count")
    p = (c.withColumn("max_count", c.agg(F.max("count")).scalar())
          .withColumn("target", (F.col("max_count") * F.lit(float(multiplier))).cast("long"))
          .withColumn("action", F.when(F.col("count") == F.col("target"), "keep")
                      .when(F.col("count") > F.col("target"), "downsample").otherwise("augment"))
          .withColumn("needed", F.when(F.col("action") == "augment", missing if cap is None else F.least(missing, F.lit(cap))).otherwise(F.lit(0))))
    return (p.withColumn("full_passes", F.floor(F.col("needed") / F.col("count")).cast("long"))
             .withColumn("last_pass", F.col("needed") % F.col("count")).withColumn("added", F.col("needed")).drop("max_count"))


def keyed_rows(df: DataFrame) -> DataFrame:
    return with_bundle(df).withColumn("bundle_key", bundle_key(F.col("bundle")))


# ---------------------------------------------------------------- D16
def downsample(keyed: DataFrame, plan: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows kept from every group — all rows of groups at or below
    target, ``target`` seeded draws of groups above it."""
    quota = plan.select("bundle_key", F.when(F.col("action") == "downsample", F.col("target"))
                        .otherwise(F.col("count")).alias("__quota"))
    return lowest_by_draw(keyed, ["bundle_key"], quota, draw_long(seed, id_col, "downsample"), tie=id_col) \
        .drop("__rank_draw")


# ---------------------------------------------------------------- D17
def replicate(rows: DataFrame, times: str, id_col: str, into: str = "pass", fan: int = FAN) -> DataFrame:
    """Every row as often as its column ``times`` (a long) says, numbered from 1 in ``into``.

    Passes are cut into ranges, ranges of ranges if need be: a row stands for a range and is
    cut into ``fan`` smaller ones at most, which are dealt out anew before they are cut
    further.  So no array and no task grows with the factor, and any factor is possible."""
    most = rows.agg(F.max(times)).first()[0] or 0
    step = 1
    while step * fan < most:
        step *= fan
    out = rows.where(F.col(times) > 0).withColumn(into, F.lit(1).cast("long")).withColumnRenamed(times, "__last")
    while True:
        out = out.withColumn(into, F.explode(F.sequence(into, "__last", F.lit(step).cast("long"))))
        out = out.withColumn("__last", F.least(F.col(into) + (step - 1), F.col("__last")))
        if step == 1:
            return out.drop("__last")
        out = out.repartition(id_col, into)
        step //= fan


def expansion_rows(keyed: DataFrame, plan: DataFrame, id_col: str, seed: int = 42, fan: int = FAN) -> DataFrame:
    """The rows to augment — every row of a group for each of its full
    passes, and ``last_pass`` seeded draws of it in one pass more.  Adds
    ``pass`` and ``aug_id`` (row id and pass, the draw key of the rewrite)."""
    plan = materialize(plan.select("bundle_key", "full_passes", "last_pass"), "plan")
    full = replicate(keyed.join(plan.where("full_passes > 0").select("bundle_key", "full_passes"), "bundle_key"), "full_passes", id_col, fan=fan)
    more = plan.where("last_pass > 0").select("bundle_key", F.col("last_pass").alias("__quota"), (F.col("full_passes") + 1).alias("pass"))
    drawn = keyed.join(more.drop("__quota"), "bundle_key")
    step = F.concat(F.lit("pass"), F.col("pass").cast("string"))
    last = lowest_by_draw(drawn, ["bundle_key"], more.drop("pass"), draw_long(seed, id_col, step), tie=id_col).drop("__rank_draw")
    return full.unionByName(last).withColumn("aug_id", F.concat_ws("#", F.col(id_col).cast("string"), F.col("pass").cast("string")))


# ---------------------------------------------------------------- D18
def balance_and_expand(kept: DataFrame, augmented: DataFrame) -> DataFrame:
    """Kept originals and augmented rows united by name (missing
    columns null), bundle key dropped."""
    return kept.drop("bundle_key", "bundle").unionByName(
        augmented.drop("bundle_key", "bundle"), allowMissingColumns=True)


# ---------------------------------------------------------------- D19 / D20
def quality_summary(df: DataFrame) -> DataFrame:
    """Per mode — samples and avg / min / max quality (3 dp)."""
    if "quality" not in df.columns:
        return df.groupBy("mode").agg(F.count(F.lit(1)).alias("samples")) \
            .withColumn("avg_quality", F.lit("N/A")).withColumn("min_quality", F.lit("N/A")) \
            .withColumn("max_quality", F.lit("N/A"))
    return df.groupBy("mode").agg(F.count(F.lit(1)).alias("samples"),
                                  F.bround(F.avg("quality"), 3).alias("avg_quality"),
                                  F.bround(F.min("quality"), 3).alias("min_quality"),
                                  F.bround(F.max("quality"), 3).alias("max_quality"))


def inspect(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` augmented rows with the reduced validity
    flag used for manual inspection."""
    s = sample_n(df, n, id_col, seed, "inspect")
    low = F.lower(F.col("augmented"))
    return s.withColumn("valid", ~low.contains("intensity") & ~F.col("augmented").contains("*")
                        & ~low.contains("rewritten"))

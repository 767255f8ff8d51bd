"""Invariants of the seeded / rows-only operators (survey §5 c)."""

from pyspark.sql import functions as F

from affect.operators import balance as B
from affect.operators import evaluate as E
from affect.operators import prepare as M
from affect.operators import rewrite as RW
from affect.operators.sampling import draw_long, lowest_by_draw
from affect.sources.fixtures import view
from tests.conftest import SF001, SF01


def _ids(df, col="utt_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_sampling_stable_under_repartition(spark):
    src = view(spark, "utterances", SF01)
    a = B.sample_n(src.repartition(1), 50, "utt_id", seed=3)
    b = B.sample_n(src.repartition(7), 50, "utt_id", seed=3)
    assert _ids(a) == _ids(b) and len(_ids(a)) == 50


def test_lowest_by_draw_equals_row_number(spark):
    from pyspark.sql import Window
    src = view(spark, "utterances", SF01).withColumn("g", F.col("turn") % 3)
    quota = src.groupBy("g").agg(F.least(F.count(F.lit(1)), F.lit(17)).cast("long").alias("__quota"))
    fast = lowest_by_draw(src, ["g"], quota, draw_long(9, "utt_id", "t"), tie="utt_id", bits=4)
    w = Window.partitionBy("g").orderBy(draw_long(9, "utt_id", "t"), "utt_id")
    slow = src.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 17)
    assert _ids(fast) == _ids(slow)


def test_stratified_split_quotas(spark):
    raw = view(spark, "labels_raw", SF01)
    loaded = M.load_labels(raw, id_col="doc_id")
    s = M.stratified_split(loaded, "sentiment_code", "doc_id", frac=0.2, seed=1)
    n = s.count()
    test = s.where(F.col("split") == "test").count()
    assert test == round(n * 0.2)
    per = {r.sentiment_code: (r.t, r.c) for r in s.groupBy("sentiment_code").agg(
        F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("c")).collect()}
    for t, c in per.values():
        assert abs(t - c * test / n) < 1.0


def test_confusion_sums_to_rows(spark):
    p = view(spark, "predictions", SF01)
    n = p.count()
    cm = E.confusion_matrix(E.sentiment_long(p), [], E.SENTIMENT_CLASSES)
    assert cm.agg(F.sum("count")).collect()[0][0] == n
    assert cm.count() == 9


def test_expansion_adds_what_is_needed(spark):
    src = view(spark, "utterances", SF01).where(F.col("domain") == "source")
    keyed = B.keyed_rows(src)
    plan = B.balance_plan(keyed, 1.0)
    exp = B.expansion_rows(keyed, plan, "utt_id")
    got = {r.bundle_key: r.n for r in exp.groupBy("bundle_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in plan.collect():
        assert got.get(r.bundle_key, 0) == r.needed


def test_rewrite_is_valid_or_original_and_seeded(spark):
    src = view(spark, "utterances", SF001).where(F.col("domain") == "source")
    rows = (src.withColumn("keywords", F.array(F.lit("home"), F.lit("work")))
               .withColumn("sentence_starters", F.array(F.lit("i"), F.lit("today")))
               .withColumn("intensifiers", F.array(F.lit("very")))
               .withColumn("avg_length", F.lit(30.0)))
    a1, _ = B.augment(rows, mode="eda", seed=5)
    a2, _ = B.augment(rows.repartition(5), mode="eda", seed=5)
    r1 = {r.utt_id: (r.augmented, r.quality) for r in a1.collect()}
    r2 = {r.utt_id: (r.augmented, r.quality) for r in a2.collect()}
    assert r1 == r2
    chk = a1.select(RW.is_valid_output(F.col("augmented")).alias("v"),
                    (F.col("augmented") == F.col("original")).alias("same"), "quality").collect()
    assert all(r.v or r.same for r in chk)
    assert all(0.0 <= r.quality <= 1.0 for r in chk)


def test_attach_patterns_bounds(spark):
    from affect.plans.q_adapt import _attached
    a = _attached(spark, SF01).select("keywords", "sentence_starters", "intensifiers", "avg_length", "examples").collect()
    assert a
    for r in a:
        assert len(r.keywords) <= 30 and len(set(r.keywords)) == len(r.keywords)
        assert 0 < len(r.sentence_starters) <= 15
        assert 0 < len(r.intensifiers) <= 15
        assert r.avg_length > 0
        assert len(r.examples) <= 6

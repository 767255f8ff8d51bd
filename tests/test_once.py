"""Work is done once a row: no text is cleaned anew for every word it is compared with, no row is
rewritten that a sample leaves out, no class is gathered in one task."""

from pyspark.sql import functions as F

from affect.operators import balance as B
from affect.operators import baseline as BL
from affect.operators import rewrite as RW


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


TEXTS = [("Note that this is edited. I went home today", "went home"), ('"It was late *sigh* ok!!"', "it was late"),
         ("This version is new\n I stayed  ,  fine", "x"), ("ok", "my own words"), ("a day of PAINTING at home", "y"),
         ("I WENT home now ", "i went home now"), ("[all of it]  \n [is meta]", "z"), (None, "none"), ("three short words", None), (None, None)]
TAKEN = ["I went home today", "It was late ok!", "I stayed, fine", "my own words", "y", "i went home now", "z", "none", "three short words", None]


def test_completion_is_cleaned_once(spark):
    rows = spark.createDataFrame(TEXTS, "completion string, original string").coalesce(1)
    out = rows.withColumn("out", RW.gate_completion("completion", "original"))
    assert [r["out"] for r in out.collect()] == TAKEN
    assert _plan(out.repartition(2)).count("In this rewritten") == 1


def test_banned_words_are_sought_in_one_lowered_text(spark):
    texts = ["fine words", "Please NOTE that", "so (Intensity 2)", "ab", "a *b", None, " *SIGH* well "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    valid = rows.withColumn("v", RW.is_valid_output("t"))
    assert {r["t"]: r["v"] for r in valid.collect()} == dict(zip(texts, [True, False, False, False, False, False, False]))
    named = rows.withColumn("v", RW.contains_label_words("t"))
    for df in (valid, named, rows.withColumn("v", RW.clean_completion("t"))):
        assert "contains(lower(" not in _plan(df).lower()


def test_inspection_derives_only_what_it_shows(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def rewritten(i):
        seen.add(1)
        return f"text {i}"

    rows = spark.range(1000).select(F.col("id").alias("utt_id"), rewritten("id").alias("augmented"))
    got = [r["utt_id"] for r in B.inspect(rows, 10, "utt_id").collect()]
    draws = spark.range(1000).select("id", B.draw_long(42, "id", "inspect").alias("d")).orderBy("d", "id").limit(10)
    assert sorted(got) == sorted(r["id"] for r in draws.collect())
    assert seen.value < 100


def test_class_weights_move_no_rows(spark):
    labels = [0] * 6 + [1] * 3 + [2] + [None] * 2
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "i int, c int").localCheckpoint()
    w = BL._weighted(rows, "c", [0, 1, 2])
    assert w.columns == ["i", "c", "__w"] or set(w.columns) == {"i", "c", "__w"}
    n = len(labels)
    assert sorted((r["i"], round(r["__w"], 9)) for r in w.collect()) == [
        (i, round(n / (3 * labels.count(c)), 9) if c is not None else 1.0) for i, c in enumerate(labels)]
    assert "Join" not in _plan(w)

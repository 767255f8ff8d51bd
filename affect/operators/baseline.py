"""M21 (re-aimed training): a distributed three-head text baseline built
from Spark ML — sentiment (multinomial, balanced class weights, M2), one
binary model per emotion (balanced class weights) and one
three-class model per emotion intensity.  ``score`` produces the score
table (logit arrays) that the decoding and evaluation operators consume.

Tokenisation and term hashing are Spark ML transformers (JVM side);
training is Spark's distributed L-BFGS.  The reference's neural encoders are
out of scope (see README).

Beside it stands a baseline in closed form (``fit_counts``, ``count_score``): naive
Bayes for all heads from one aggregate, with M2's weights for sentiments and
M3's for emotions, which SQL can check."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affect.operators.text import term_counts, word_tokens
from affect.session import materialize


def heads(names: list[str]) -> list[tuple[str, int]]:
    """(label column, number of classes) of every head."""
    return [("sentiment_code", 3), *[(f"em__{e}", 2) for e in names], *[(f"int__{e}", 3) for e in names]]


def fit_counts(train: DataFrame, names: list[str], text_col: str = "text") -> tuple[DataFrame, dict]:
    """Naive Bayes of all heads: (term, ``t_<head>_<class>`` weighted counts), and the classes' weighted
    sizes.  One aggregate: rows are cut into (term, tf) and one more entry without a term, which counts the rows.
    Sentiments weigh n / (3 count) (M2), emotions that are present 1 / (frequency + 1e-6) (M3)."""
    columns = [(h, c) for h, k in heads(names) for c in range(k)]
    one = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf")))
    rows = train.select(*[h for h, _ in heads(names)], F.inline(F.concat(one, term_counts(word_tokens(F.col(text_col))))))
    counts = materialize(rows.groupBy("term").agg(*[F.sum(F.when(F.col(h) == c, F.col("tf")).otherwise(0)).cast("double").alias(f"t_{h}_{c}") for h, c in columns],
                                                  F.sum("tf").cast("double").alias("__all")), "term_counts")
    docs = counts.where("term is null").first()
    known = counts.where("term is not null")
    sums = known.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"t_{h}_{c}").alias(f"t_{h}_{c}") for h, c in columns]).first()
    n = docs["__all"] if docs else 0.0

    def weight(h: str, c: int) -> float:
        m = docs[f"t_{h}_{c}"] if docs else 0.0
        if h == "sentiment_code":
            return n / (3.0 * m) if m > 0 else 1.0
        return 1.0 / (docs[f"t_{h}_1"] / n + 1e-6) if h.startswith("em__") and c == 1 and n else 1.0

    sizes = {(h, c): (weight(h, c), docs[f"t_{h}_{c}"] if docs else 0.0, sums[f"t_{h}_{c}"] or 0.0) for h, c in columns}
    return known.drop("__all"), {"classes": sizes, "terms": float(sums["v"])}


def count_score(model: tuple[DataFrame, dict], df: DataFrame, names: list[str], id_col: str, text_col: str = "text") -> DataFrame:
    """Score table as of :func:`score`: log posteriors of add-one naive Bayes, rounded to 9 places (so that equal ones tie).
    Only (row, term, tf) is shuffled, to the counts and back."""
    counts, sizes = model
    d = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "scored")
    terms = d.select("__row", F.inline(term_counts(word_tokens(F.col(text_col))))).join(counts, "term", "left")
    sums, logits = [], {}
    for (h, c), (w, n, t) in sizes["classes"].items():
        p = (F.lit(w) * F.coalesce(f"t_{h}_{c}", F.lit(0.0)) + 1.0) / (F.lit(w) * t + sizes["terms"])
        sums.append(F.sum(F.col("tf") * F.log(p)).alias(f"l_{h}_{c}"))
        logits[h, c] = F.round(F.log(F.lit(w) * n + 1.0) + F.coalesce(f"l_{h}_{c}", F.lit(0.0)), 9)
    x = d.join(terms.groupBy("__row").agg(*sums), "__row", "left")
    return x.select(F.col(id_col), F.col("sentiment_code").alias("sentiment_true"),
                    F.array(*[logits["sentiment_code", c] for c in range(3)]).alias("sentiment_logits"),
                    F.array(*[logits[f"em__{e}", 1] - logits[f"em__{e}", 0] for e in names]).alias("emotion_logits"),
                    F.array(*[logits[f"int__{e}", c] for e in names for c in range(3)]).alias("intensity_logits"),
                    F.array(*[F.col(f"em__{e}") for e in names]).alias("emotion_true"),
                    F.array(*[F.col(f"int__{e}") for e in names]).alias("intensity_true"))


def featurizer(text_col: str = "text", num_features: int = 1 << 16) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False,
                       toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="features")])


def _weighted(df: DataFrame, label: str, classes: list[int]) -> DataFrame:
    """Balanced class weights n / (k * count_c) as a weight column, looked up in a map of the classes: the rows stay
    where they are (a join would send all rows of a class to one task)."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    w = cnt.withColumn("__w", F.sum("__c").over(Window.partitionBy()) / (F.lit(len(classes)) * F.col("__c")))
    known = w.where(F.col(label).isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct(label, "__w")))).scalar()
    return df.withColumn("__w", F.coalesce(known[F.col(label)], F.lit(1.0)))


def fit_baseline(train: DataFrame, names: list[str], text_col: str = "text", max_iter: int = 30,
                 num_features: int = 1 << 16) -> dict:
    """Fit featurizer + sentiment model + per-emotion presence and intensity
    models on parsed label rows (text, sentiment_code, em__e, int__e)."""
    feat = featurizer(text_col, num_features).fit(train)
    x = feat.transform(train).select("features", "sentiment_code", *[f"em__{e}" for e in names],
                                     *[f"int__{e}" for e in names]).persist()
    models = {"featurizer": feat}
    sw = _weighted(x, "sentiment_code", [0, 1, 2])
    models["sentiment"] = LogisticRegression(featuresCol="features", labelCol="sentiment_code", weightCol="__w",
                                             family="multinomial", maxIter=max_iter).fit(
        sw.withColumn("sentiment_code", F.col("sentiment_code").cast("double")))
    for e in names:
        ew = _weighted(x, f"em__{e}", [0, 1])
        models[f"em__{e}"] = LogisticRegression(featuresCol="features", labelCol=f"em__{e}", weightCol="__w",
                                                maxIter=max_iter).fit(
            ew.withColumn(f"em__{e}", F.col(f"em__{e}").cast("double")))
        models[f"int__{e}"] = LogisticRegression(featuresCol="features", labelCol=f"int__{e}", family="multinomial",
                                                 maxIter=max_iter).fit(
            x.withColumn(f"int__{e}", F.col(f"int__{e}").cast("double")))
    x.unpersist()
    return models


def score(models: dict, df: DataFrame, names: list[str], id_col: str) -> DataFrame:
    """Score table: (id, sentiment_true, sentiment_logits[3], emotion_logits[k],
    intensity_logits[3k], emotion_true[k], intensity_true[k])."""
    feat: PipelineModel = models["featurizer"]
    d = feat.transform(df)
    d = models["sentiment"].transform(d).withColumn("__s", vector_to_array("rawPrediction")) \
        .drop("rawPrediction", "probability", "prediction")
    for e in names:
        d = models[f"em__{e}"].transform(d).withColumn(f"__e_{e}", vector_to_array("rawPrediction")[1]) \
            .drop("rawPrediction", "probability", "prediction")
        m = models[f"int__{e}"]
        d = m.transform(d).withColumn(f"__i_{e}", F.slice(F.concat(vector_to_array("rawPrediction"),
                                                                    F.array(*[F.lit(-1e9)] * 3)), 1, 3)) \
            .drop("rawPrediction", "probability", "prediction")
    return d.select(F.col(id_col), F.col("sentiment_code").alias("sentiment_true"),
                    F.slice(F.concat("__s", F.array(*[F.lit(-1e9)] * 3)), 1, 3).alias("sentiment_logits"),
                    F.array(*[F.col(f"__e_{e}") for e in names]).alias("emotion_logits"),
                    F.flatten(F.array(*[F.col(f"__i_{e}") for e in names])).alias("intensity_logits"),
                    F.array(*[F.col(f"em__{e}") for e in names]).alias("emotion_true"),
                    F.array(*[F.col(f"int__{e}") for e in names]).alias("intensity_true"))

"""Registered corpus-profile queries (cleaning N*, label structure L*,
profile A*) over the ``utterances`` / ``labels_raw`` adapter views, each with
its DuckDB oracle text."""

from __future__ import annotations

from pyspark.sql import functions as F

from affect.functions import clean as C
from affect.operators import labels as L
from affect.operators import profile as P
from affect.plans import sqltext as S
from affect.sources.fixtures import cte, view

Q: dict = {}
O: dict = {}


def _utt(spark, sf):
    return view(spark, "utterances", sf)


U = cte("utterances")
EMO = f"{U}, e AS (SELECT *, {S.emotions_array()} AS emotions FROM utterances)\n"

# ---------------------------------------------------------------- N1-N3, N10, N11
Q["n1_strict_labels"] = lambda spark, sf: _utt(spark, sf).select(
    "utt_id", *[C.normalize_label_strict(e).alias(f"strict{k + 1}") for k, (e, _) in enumerate(L.SLOTS)])
O["n1_strict_labels"] = U + "SELECT utt_id, " + ", ".join(
    f"{S.strict(e)} AS strict{k + 1}" for k, (e, _) in enumerate(L.SLOTS)) + " FROM utterances"

Q["n2_lenient_labels"] = lambda spark, sf: _utt(spark, sf).select(
    "utt_id", *[C.normalize_label(e).alias(f"label{k + 1}") for k, (e, _) in enumerate(L.SLOTS)])
O["n2_lenient_labels"] = U + "SELECT utt_id, " + ", ".join(
    f"{S.lenient(e)} AS label{k + 1}" for k, (e, _) in enumerate(L.SLOTS)) + " FROM utterances"

Q["n3_n10_numeric_intensity"] = lambda spark, sf: _utt(spark, sf).select(
    "utt_id", *[C.to_num(i).alias(f"num{k + 1}") for k, (_, i) in enumerate(L.SLOTS)],
    *[C.trunc_int(i).alias(f"int{k + 1}") for k, (_, i) in enumerate(L.SLOTS)])
O["n3_n10_numeric_intensity"] = U + "SELECT utt_id, " + ", ".join(
    [f"{S.to_num(i)} AS num{k + 1}" for k, (_, i) in enumerate(L.SLOTS)]
    + [f"{S.trunc_int(i)} AS int{k + 1}" for k, (_, i) in enumerate(L.SLOTS)]) + " FROM utterances"

Q["n11_word_count"] = lambda spark, sf: _utt(spark, sf).select(
    "utt_id", C.word_count("utterance").alias("words"))
O["n11_word_count"] = U + f"SELECT utt_id, CAST({S.word_count('utterance')} AS INTEGER) AS words FROM utterances"

# ---------------------------------------------------------------- L1-L5
Q["l1_emotion_arrays"] = lambda spark, sf: L.with_emotions(_utt(spark, sf)).select(
    "utt_id", F.array_join("emotions", "|").alias("emotions"), "num_emotions")
O["l1_emotion_arrays"] = EMO + "SELECT utt_id, array_to_string(emotions, '|') AS emotions, " \
                               "CAST(len(emotions) AS INTEGER) AS num_emotions FROM e"

Q["l2_explode_slots"] = lambda spark, sf: L.explode_slots(
    _utt(spark, sf), keep=["utt_id", "sentiment"]).select("utt_id", "sentiment", "slot", "emotion", "intensity")
O["l2_explode_slots"] = U + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT utt_id, sentiment, {k + 1} AS slot, {S.lenient(e)} AS emotion, {S.to_num(i)} AS intensity "
    f"FROM utterances" for k, (e, i) in enumerate(L.SLOTS)) + ") WHERE emotion IS NOT NULL AND intensity IS NOT NULL"

Q["l4_bundle_key"] = lambda spark, sf: L.with_bundle_key(_utt(spark, sf)).select(
    "utt_id", "bundle_key", F.size("bundle").alias("bundle_size"))
O["l4_bundle_key"] = U + ", b AS (SELECT utt_id, list_filter([" + ", ".join(
    f"{{'e': {S.lenient(e)}, 'i': {S.to_num(i)}}}" for e, i in L.SLOTS) + \
    "], lambda x: x.e IS NOT NULL AND x.i IS NOT NULL) AS bundle FROM utterances)\n" \
    "SELECT utt_id, CASE WHEN len(bundle)=0 THEN 'neutral:2' ELSE array_to_string(list_sort(" \
    "list_transform(bundle, lambda x: x.e || ':' || CAST(CAST(trunc(x.i) AS INTEGER) AS VARCHAR))), '|') END AS bundle_key, " \
    "CAST(len(bundle) AS INTEGER) AS bundle_size FROM b"

Q["l5_vocabulary"] = lambda spark, sf: L.vocabulary(_utt(spark, sf))
O["l5_vocabulary"] = U + "SELECT DISTINCT emotion FROM (" + " UNION ALL ".join(
    f"SELECT {S.lenient(e)} AS emotion FROM utterances" for e, _ in L.SLOTS) + \
    ") WHERE emotion IS NOT NULL AND emotion <> 'nan' ORDER BY emotion"

# ---------------------------------------------------------------- A1-A7
Q["a1_num_emotions"] = lambda spark, sf: P.num_emotions_table(_utt(spark, sf))
O["a1_num_emotions"] = EMO + """SELECT CAST(len(emotions) AS INTEGER) AS num_emotions, count(*) AS count,
 round_even(count(*) / (SELECT count(*) FROM e) * 100, 2) AS percentage FROM e GROUP BY 1 ORDER BY 1"""

Q["a2_multilabel_summary"] = lambda spark, sf: P.multilabel_summary(_utt(spark, sf))
O["a2_multilabel_summary"] = EMO + """, c AS (SELECT count(*) AS t, count_if(len(emotions)=0) AS z,
 count_if(len(emotions)=1) AS o, count_if(len(emotions)>=2) AS m, count_if(len(emotions)=3) AS th FROM e)
SELECT pos, metric, value, round_even(value / t * 100, 2) AS percentage FROM c,
 (VALUES (1, 'Total utterances'), (2, 'Neutral only (0 emotions)'), (3, 'Single emotion'),
         (4, 'Multilabel (≥2 emotions)'), (5, 'Three emotions')) v(pos, metric),
 LATERAL (SELECT CASE pos WHEN 1 THEN t WHEN 2 THEN z WHEN 3 THEN o WHEN 4 THEN m ELSE th END AS value)
ORDER BY pos"""

O["a3_emotion_pairs"] = EMO + """, s AS (SELECT list_sort(emotions) AS s FROM e WHERE len(emotions) >= 2),
p AS (SELECT s[i] || ' + ' || s[j] AS emotion_pair FROM s, range(1, 4) a(i), range(1, 4) b(j)
      WHERE i < j AND j <= len(s))
SELECT emotion_pair, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM e) * 100, 2) AS percentage
FROM p GROUP BY 1 ORDER BY count DESC, emotion_pair"""
Q["a3_emotion_pairs"] = lambda spark, sf: P.emotion_pairs(_utt(spark, sf))

Q["a4_sentiment_multilabel"] = lambda spark, sf: P.sentiment_multilabel(_utt(spark, sf))
O["a4_sentiment_multilabel"] = EMO + """SELECT sentiment, round_even(avg(len(emotions)), 2) AS avg_num_emotions,
 round_even(avg(CASE WHEN len(emotions) >= 2 THEN 1.0 ELSE 0.0 END) * 100, 2) AS multilabel_percentage
FROM e WHERE sentiment IS NOT NULL GROUP BY sentiment ORDER BY sentiment"""

_MI = ("(list_sum(list_filter([" + ", ".join(S.to_num(i) for _, i in L.SLOTS) + "], lambda x: x IS NOT NULL)) / "
       "nullif(len(list_filter([" + ", ".join(S.to_num(i) for _, i in L.SLOTS) + "], lambda x: x IS NOT NULL)), 0))")
Q["a5_mean_intensity"] = lambda spark, sf: P.mean_intensity(_utt(spark, sf)).select(
    "utt_id", F.round("mean_intensity", 6).alias("mean_intensity"))
O["a5_mean_intensity"] = U + f"SELECT utt_id, round({_MI}, 6) AS mean_intensity FROM utterances"

Q["a6_intensity_by_cardinality"] = lambda spark, sf: P.intensity_by_cardinality(_utt(spark, sf))
O["a6_intensity_by_cardinality"] = EMO + f""", m AS (SELECT len(emotions) AS k, {_MI} AS mi FROM e)
SELECT CAST(k AS INTEGER) AS num_emotions, round_even(avg(mi), 2) AS avg_intensity,
 round_even(max(mi), 2) AS max_intensity, count(mi) AS count FROM m GROUP BY k ORDER BY k"""

Q["a7_emotion_frequency"] = lambda spark, sf: P.emotion_frequency(_utt(spark, sf))
O["a7_emotion_frequency"] = EMO + """SELECT emotion, count(*) AS frequency,
 round_even(count(*) / (SELECT count(*) FROM e) * 100, 2) AS percentage
FROM (SELECT unnest(emotions) AS emotion FROM e) GROUP BY emotion ORDER BY frequency DESC, emotion"""

# ---------------------------------------------------------------- A8-A14
Q["a8_sentiment_distribution"] = lambda spark, sf: P.sentiment_distribution(_utt(spark, sf))
O["a8_sentiment_distribution"] = U + """SELECT sentiment, count(*) AS count FROM utterances
WHERE sentiment IS NOT NULL GROUP BY 1 ORDER BY count DESC, sentiment"""

Q["a9_emotion_presence"] = lambda spark, sf: P.emotion_presence(_utt(spark, sf))
O["a9_emotion_presence"] = U + "SELECT emotion, count(*) AS count FROM (" + " UNION ALL ".join(
    f"SELECT {e} AS emotion FROM utterances" for e, _ in L.SLOTS) + \
    ") WHERE emotion IS NOT NULL AND emotion <> '' GROUP BY 1 ORDER BY count DESC, emotion"

Q["a10_multi_emotion_ratio"] = lambda spark, sf: P.multi_emotion_ratio(_utt(spark, sf)).select(
    F.round("avg_emotions", 6).alias("avg_emotions"), F.round("multi_percentage", 6).alias("multi_percentage"))
_NE = " + ".join(f"(CASE WHEN {e} IS NOT NULL THEN 1 ELSE 0 END)" for e, _ in L.SLOTS)
O["a10_multi_emotion_ratio"] = U + f"""SELECT round(avg({_NE}), 6) AS avg_emotions,
 round(avg(CASE WHEN ({_NE}) > 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS multi_percentage FROM utterances"""

# Raw labels of the fixture (the crosstab's column set is data-dependent;
# the query passes it explicitly, the operator can also discover it).
RAW_LABELS = sorted(['Joy', 'anger', 'SADNESS', 'neutral', ' disgust ', 'fear', 'surprise',
                     'acceptance', 'no-label', 'guilt'])
Q["a11_emotion_intensity_open"] = lambda spark, sf: P.emotion_intensity_long(_utt(spark, sf))
Q["a11_emotion_intensity_crosstab"] = lambda spark, sf: P.emotion_intensity_crosstab(_utt(spark, sf), RAW_LABELS)
_EIL = " UNION ALL ".join(f"SELECT {e} AS emotion, {S.trunc_int(i)} AS intensity FROM utterances"
                          for e, i in L.SLOTS)
O["a11_emotion_intensity_open"] = U + f", r AS ({_EIL})\nSELECT intensity, emotion, count(*) AS count FROM r WHERE emotion IS NOT NULL AND emotion <> '' AND intensity IS NOT NULL GROUP BY ALL"
O["a11_emotion_intensity_crosstab"] = U + f", r AS ({_EIL})\nSELECT intensity, " + ", ".join(
    f"CAST(count_if(emotion = '{v}') AS BIGINT) AS \"{v}\"" for v in RAW_LABELS) + \
    " FROM r WHERE emotion IS NOT NULL AND emotion <> '' AND intensity IS NOT NULL GROUP BY intensity ORDER BY intensity"

Q["a12_intensity_counts"] = lambda spark, sf: P.intensity_counts(_utt(spark, sf))
O["a12_intensity_counts"] = U + "SELECT intensity, count(*) AS count FROM (" + " UNION ALL ".join(
    f"SELECT {S.trunc_int(i)} AS intensity FROM utterances" for _, i in L.SLOTS) + \
    ") WHERE intensity IS NOT NULL GROUP BY 1 ORDER BY 1"

_BR = U + f""", g AS (SELECT lower({S.strip('emotion1')}) AS emotion1, {S.to_num('intensity1')} AS intensity1,
 count(*) AS count FROM utterances WHERE emotion1 IS NOT NULL AND {S.to_num('intensity1')} IS NOT NULL GROUP BY 1, 2)
"""
Q["a13_balance_report"] = lambda spark, sf: P.balance_report(_utt(spark, sf))
O["a13_balance_report"] = _BR + """SELECT emotion1, intensity1, count, (SELECT max(count) FROM g) - count AS needed_to_balance
FROM g ORDER BY count DESC, emotion1, intensity1"""

Q["a14_balance_summary"] = lambda spark, sf: P.balance_summary(_utt(spark, sf))
O["a14_balance_summary"] = _BR + """SELECT (SELECT count(*) FROM utterances) AS total_original_samples,
 count(*) AS unique_combinations, max(count) AS max_per_group,
 CAST(sum((SELECT max(count) FROM g) - count) AS BIGINT) AS needed_to_balance,
 CAST(sum((SELECT max(count) FROM g) - count) AS BIGINT) AS recommended_num_samples, 70 AS recommended_expand_percent FROM g"""

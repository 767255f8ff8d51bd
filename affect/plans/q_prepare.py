"""Registered label-preparation queries: S8, M0-M3, L6-L9, A15-A18."""

from __future__ import annotations

from pyspark.sql import functions as F

from affect.operators import baseline as BL
from affect.operators import evaluate as E
from affect.operators import labels as L
from affect.operators import prepare as M
from affect.operators import profile as P
from affect.operators.sampling import draw_long_sql
from affect.plans import sqltext as S
from affect.session import materialize
from affect.sources.fixtures import cte, view

Q: dict = {}
O: dict = {}

NAMES = ["joy", "anger"]  # emotion__* columns of labels_raw, in column order


def _raw(spark, sf):
    return view(spark, "labels_raw", sf)


def _loaded(spark, sf):
    return M.load_labels(_raw(spark, sf), id_col="doc_id")


R = cte("labels_raw")
_T0 = S.strip("coalesce(augmented, '')")
_O0 = S.strip("coalesce(original, '')")
LOADED = R + f""", r AS (SELECT *, {_T0} AS t0, {_O0} AS o0 FROM labels_raw),
l AS (SELECT *, CASE WHEN length(t0) >= 5 THEN t0 WHEN length(o0) >= 5 THEN o0 ELSE t0 END AS text FROM r),
p AS (SELECT doc_id, text, {S.sentiment_code('sentiment')} AS sentiment_code,
  {', '.join(f"{S.to_flag(f'emotion__{e}', e)} AS em__{e}" for e in NAMES)},
  {', '.join(f"CAST(CASE WHEN emotion__{e} IS NULL THEN 0 ELSE {S.intensity_class(f'intensity__{e}')} END AS INTEGER) AS int__{e}" for e in NAMES)}
  FROM l WHERE length(text) >= 5)
"""

# ---------------------------------------------------------------- S8
Q["s8_validate_one_hot"] = lambda spark, sf: M.validate_one_hot(_raw(spark, sf))
_key = f"lower({S.strip('CAST(sentiment AS VARCHAR)')})"
_known = f"{_key} IN ('neg','negative','0','neu','neutral','1','pos','positive','2')"
_checks = [("sentiment", "defaulted_to_neutral", f"NOT ({_known}) AND {S.finite(_key)} IS NULL"),
           ("sentiment", "clamped", f"NOT ({_known}) AND {S.finite(_key)} IS NOT NULL AND "
                                    f"({S.py_int(S.finite(_key))} < 0 OR {S.py_int(S.finite(_key))} > 2)")]
for _e in NAMES:
    _s = f"lower({S.strip(f'CAST(emotion__{_e} AS VARCHAR)')})"
    _checks.append((f"emotion__{_e}", "unrecognised_flag",
                    f"emotion__{_e} IS NOT NULL AND {_s} NOT IN ('1','1.0','true','t','yes','y',"
                    f"'0','0.0','false','f','no','n','','{_e}')"))
    _v = S.finite(f"CAST(intensity__{_e} AS VARCHAR)")
    _checks.append((f"intensity__{_e}", "unparsable", f"intensity__{_e} IS NOT NULL AND {_v} IS NULL"))
    _checks.append((f"intensity__{_e}", "out_of_range",
                    f"{_v} IS NOT NULL AND ({S.py_int(_v)} < 1 OR {S.py_int(_v)} > 3)"))
_checks.append(("augmented", "shorter_than_5", f"length({_T0}) < 5"))
O["s8_validate_one_hot"] = R + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS \"check\", count_if({cond}) AS violations FROM labels_raw"
    for c, k, cond in _checks)

# ---------------------------------------------------------------- M0 / L8
Q["m0_load_labels"] = lambda spark, sf: _loaded(spark, sf).select(
    "doc_id", "text", "sentiment_code", *[f"em__{e}" for e in NAMES], *[f"int__{e}" for e in NAMES],
    F.array_join("emotion_labels", ",").alias("emotion_labels"),
    F.array_join("intensity_labels", ",").alias("intensity_labels"))
O["m0_load_labels"] = LOADED + "SELECT *, " + \
    "concat_ws(',', " + ", ".join(f"em__{e}" for e in NAMES) + ") AS emotion_labels, " + \
    "concat_ws(',', " + ", ".join(f"int__{e}" for e in NAMES) + ") AS intensity_labels FROM p"


def _stats(spark, sf):
    raw = _raw(spark, sf)
    return M.load_statistics(raw, M.load_labels(raw, id_col="doc_id"), NAMES).select(
        "loaded", "skipped", "sentiment_0", "sentiment_1", "sentiment_2",
        F.round("avg_emotions", 6).alias("avg_emotions"),
        F.round("single_label_ratio", 6).alias("single_label_ratio"),
        "one_emotion", "two_emotions", "three_plus", "mode")


_NEM = " + ".join(f"em__{e}" for e in NAMES)
Q["m0_load_statistics"] = _stats
O["m0_load_statistics"] = LOADED + f"""SELECT count(*) AS loaded, (SELECT count(*) FROM labels_raw) - count(*) AS skipped,
 count_if(sentiment_code=0) AS sentiment_0, count_if(sentiment_code=1) AS sentiment_1, count_if(sentiment_code=2) AS sentiment_2,
 round(avg({_NEM}), 6) AS avg_emotions, round(avg(CASE WHEN {_NEM} <= 1 THEN 1.0 ELSE 0.0 END), 6) AS single_label_ratio,
 count_if({_NEM} = 1) AS one_emotion, count_if({_NEM} = 2) AS two_emotions, count_if({_NEM} >= 3) AS three_plus,
 CASE WHEN avg(CASE WHEN {_NEM} <= 1 THEN 1.0 ELSE 0.0 END) < 0.95 THEN 'multi-label' ELSE 'single-emotion' END AS mode
FROM p"""

Q["l9_label_mode"] = lambda spark, sf: L.label_mode(_loaded(spark, sf)).select(
    F.round("single_label_ratio", 6).alias("single_label_ratio"), "mode")
O["l9_label_mode"] = LOADED + f"""SELECT round(avg(CASE WHEN {_NEM} <= 1 THEN 1.0 ELSE 0.0 END), 6) AS single_label_ratio,
 CASE WHEN avg(CASE WHEN {_NEM} <= 1 THEN 1.0 ELSE 0.0 END) < 0.95 THEN 'multi-label' ELSE 'single-emotion' END AS mode FROM p"""

# ---------------------------------------------------------------- A15-A17
Q["a15_cooccurrence_stats"] = lambda spark, sf: P.cooccurrence_stats(_loaded(spark, sf), NAMES)
O["a15_cooccurrence_stats"] = LOADED + f"""SELECT count_if({_NEM} = 1) AS one_emotion, count_if({_NEM} = 2) AS two_emotions,
 count_if({_NEM} >= 3) AS three_plus, round(count_if({_NEM} = 1) / count(*) * 100, 6) AS one_emotion_pct,
 round(count_if({_NEM} = 2) / count(*) * 100, 6) AS two_emotions_pct, round(count_if({_NEM} >= 3) / count(*) * 100, 6) AS three_plus_pct
FROM p"""

Q["a16_avg_intensity"] = lambda spark, sf: P.avg_intensity(_loaded(spark, sf), NAMES)
O["a16_avg_intensity"] = LOADED + " UNION ALL ".join(
    [f"SELECT '{e}' AS emotion, round(avg(int__{e}), 6) AS avg_intensity FROM p" for e in NAMES]
    + ["SELECT '__overall__' AS emotion, round(coalesce(sum(v) / count(v), 0.0), 6) AS avg_intensity FROM ("
       + " UNION ALL ".join(f"SELECT int__{e} AS v FROM p WHERE int__{e} > 0" for e in NAMES) + ")"])

Q["a17_presence_rates"] = lambda spark, sf: P.presence_rates(_loaded(spark, sf), NAMES)
O["a17_presence_rates"] = LOADED + " UNION ALL ".join(
    f"SELECT '{e}' AS emotion, CAST(sum(em__{e}) AS BIGINT) AS present, round(sum(em__{e}) / count(*) * 100, 6) AS present_pct FROM p"
    for e in NAMES)

# ---------------------------------------------------------------- M1-M3
Q["m1_stratified_split"] = lambda spark, sf: M.stratified_split(
    _loaded(spark, sf), by="sentiment_code", id_col="doc_id", frac=0.2, seed=42).select("doc_id", "sentiment_code", "split")
O["m1_stratified_split"] = LOADED + f""", c AS (SELECT sentiment_code, count(*) AS n FROM p GROUP BY 1),
t AS (SELECT *, sum(n) OVER () AS big_n, CAST(round(sum(n) OVER () * 0.2) AS BIGINT) AS total_test FROM c),
f AS (SELECT *, n * total_test / big_n AS exact, CAST(floor(n * total_test / big_n) AS BIGINT) AS fl FROM t),
q AS (SELECT sentiment_code, fl + CASE WHEN row_number() OVER (ORDER BY exact - fl DESC, sentiment_code)
        <= total_test - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f),
ranked AS (SELECT p.doc_id, p.sentiment_code, q.quota, row_number() OVER (PARTITION BY p.sentiment_code
   ORDER BY {draw_long_sql(42, 'p.doc_id', 'split')}, p.doc_id) AS rn FROM p JOIN q USING (sentiment_code))
SELECT doc_id, sentiment_code, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM ranked"""


def _m1_fallback(spark, sf):
    """Strata by text length, of which some have one row: the split cannot be stratified."""
    df = _loaded(spark, sf).withColumn("stratum", F.length("text"))
    return M.split(df, by="stratum", id_col="doc_id").select("doc_id", "split")


Q["m1_split_fallback"] = _m1_fallback
O["m1_split_fallback"] = LOADED + f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {draw_long_sql(42, 'doc_id', 'split')}, doc_id)
  <= round((SELECT count(*) FROM p) * 0.2) THEN 'test' ELSE 'train' END AS split FROM p"""


def _m2(spark, sf):
    split = M.stratified_split(_loaded(spark, sf), by="sentiment_code", id_col="doc_id", frac=0.2, seed=42)
    w = M.class_weights(split.where(F.col("split") == "train"), "sentiment_code", [0, 1, 2])
    return w.select("sentiment_code", "count", F.round("weight", 6).alias("weight"))


Q["m2_class_weights"] = _m2
O["m2_class_weights"] = O["m1_stratified_split"].rsplit("SELECT doc_id, sentiment_code, CASE", 1)[0] + \
    """, tr AS (SELECT sentiment_code FROM ranked WHERE rn > quota),
cnt AS (SELECT sentiment_code, count(*) AS count FROM tr GROUP BY 1)
SELECT k.sentiment_code, coalesce(cnt.count, 0) AS count,
 round(coalesce((SELECT count(*) FROM tr) / (3 * cnt.count), 1.0), 6) AS weight
FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS sentiment_code) k LEFT JOIN cnt USING (sentiment_code)"""

Q["m3_label_weights"] = lambda spark, sf: M.label_weights(_loaded(spark, sf), NAMES).select(
    "emotion", F.round("frequency", 6).alias("frequency"), F.round("weight", 6).alias("weight"))
O["m3_label_weights"] = LOADED + " UNION ALL ".join(
    f"SELECT '{e}' AS emotion, round(avg(em__{e}), 6) AS frequency, round(1.0 / (avg(em__{e}) + 1e-6), 6) AS weight FROM p"
    for e in NAMES)

# ---------------------------------------------------------------- L6 / L7 (slot corpus)
UTT_VOCAB = ["acceptance", "anger", "disgust", "fear", "guilt", "joy", "neutral", "no-label", "sadness", "surprise"]


def _one_hot(spark, sf):
    u = view(spark, "utterances", sf)
    vocab = L.collect_vocabulary(u)  # bounded by the number of labels
    return L.one_hot(u, vocab, text_col="utterance", id_col="utt_id")


Q["l6_one_hot"] = _one_hot
_U = cte("utterances")
_ENT = "list_filter([" + ", ".join(
    f"{{'k': {S.lenient(e)}, 'v': coalesce({S.trunc_int(i)}, 2)}}" for e, i in L.SLOTS) + \
    "], lambda x: x.k IS NOT NULL AND x.k <> 'nan')"
O["l6_one_hot"] = _U + f", s AS (SELECT *, {_ENT} AS ent FROM utterances)\nSELECT utt_id, utterance, sentiment, " + ", ".join(
    f"CASE WHEN len(list_filter(ent, lambda x: x.k = '{e}')) > 0 THEN 1 ELSE 0 END AS \"emotion__{e}\", "
    f"CAST(coalesce(list_filter(ent, lambda x: x.k = '{e}')[-1].v, 0) AS INTEGER) AS \"intensity__{e}\""
    for e in UTT_VOCAB) + " FROM s"


def _melt(spark, sf):
    oh = _one_hot(spark, sf)
    return L.melt_one_hot(oh, UTT_VOCAB, "utt_id").where(F.col("present") == 1)


Q["l7_melt_one_hot"] = _melt
O["l7_melt_one_hot"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT utt_id, '{e}' AS emotion, \"emotion__{e}\" AS present, \"intensity__{e}\" AS intensity FROM oh"
    for e in UTT_VOCAB) + ") WHERE present = 1"
O["l7_melt_one_hot"] = O["l6_one_hot"].replace("\nSELECT utt_id, utterance", ", oh AS (SELECT utt_id, utterance", 1) + ")\n" + O["l7_melt_one_hot"]

Q["l7_melt_open"] = lambda spark, sf: L.melt_map(L.one_hot_map(view(spark, "utterances", sf), ["utt_id"]), "utt_id")
O["l7_melt_open"] = _U + f""", s AS (SELECT row_number() OVER () AS rid, utt_id, {_ENT} AS ent FROM utterances),
x AS (SELECT rid, utt_id, unnest(ent) AS en, unnest(range(1, len(ent) + 1)) AS j FROM s)
SELECT utt_id, en.k AS emotion, 1 AS present, CAST(arg_max(en.v, j) AS INTEGER) AS intensity FROM x GROUP BY rid, utt_id, en.k"""

# ---------------------------------------------------------------- A18 (experiment results table)
_NUM = ["run_id", "precision", "recall", "f1_score", "support"]
_ALLC = ["run_id", "architecture", "encoder", "emotion", "precision", "recall", "f1_score", "support"]
Q["a18_profile"] = lambda spark, sf: P.profile(view(spark, "results", sf), _NUM)
_RS = cte("results")
Q["a18_head"] = lambda spark, sf: P.head(view(spark, "results", sf), "run_id")
O["a18_head"] = _RS + "SELECT * FROM results ORDER BY run_id, architecture, encoder, emotion, precision, recall, f1_score, support LIMIT 5"
_parts = ["SELECT '__table__' AS \"column\", 'rows' AS statistic, CAST(count(*) AS DOUBLE) AS value FROM results",
          f"SELECT '__table__', 'columns', {float(len(_ALLC))} FROM results LIMIT 1"]
_parts += [f"SELECT '{c}', 'nulls', CAST(count_if({c} IS NULL) AS DOUBLE) FROM results" for c in _ALLC]
for _c in _NUM:
    _x = f"CAST({_c} AS DOUBLE)"
    _parts.append(f"SELECT '{_c}', unnest(['count','mean','std','min','25%','50%','75%','max']), "
                  f"round(unnest([CAST(count({_x}) AS DOUBLE), avg({_x}), stddev_samp({_x}), min({_x}), "
                  f"quantile_cont({_x}, 0.25), quantile_cont({_x}, 0.5), quantile_cont({_x}, 0.75), max({_x})]), 6) FROM results")
O["a18_profile"] = _RS + "SELECT \"column\", statistic, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"({x})" for x in _parts) + ")"


# ---------------------------------------------------------------- M21
def _halves(spark, sf):
    split = materialize(M.stratified_split(_loaded(spark, sf), by="sentiment_code", id_col="doc_id", frac=0.2, seed=42), "split")
    return split.where("split = 'train'"), split.where("split = 'test'")


def _m21(spark, sf):  # rows-only: iterative training
    train, test = _halves(spark, sf)
    models = BL.fit_baseline(train, NAMES, max_iter=10, num_features=1 << 14)
    sc = BL.score(models, test, NAMES, "doc_id")
    return E.predictions_table(sc, NAMES, id_col="doc_id")


Q["m21_baseline_predictions"] = _m21


def _m21_counts(spark, sf):
    train, test = _halves(spark, sf)
    sc = BL.count_score(BL.fit_counts(train, NAMES), test, NAMES, "doc_id")
    return E.predictions_table(sc, NAMES, id_col="doc_id")


Q["m21_count_predictions"] = _m21_counts
_HEADS = [("sentiment_code", c, 3) for c in range(3)] + [x for e in NAMES for x in [(f"em__{e}", 0, 2), (f"em__{e}", 1, 2)]] + \
    [(f"int__{e}", c, 3) for e in NAMES for c in range(3)]


def _weight_sql(h: str, c: int) -> str:
    if h == "sentiment_code":
        return f"(CASE WHEN n_{h}_{c} > 0 THEN n_all / (3.0 * n_{h}_{c}) ELSE 1.0 END)"
    return f"(1.0 / (n_{h}_1 / n_all + 1e-6))" if h.startswith("em__") and c == 1 else "1.0"


_LL = {(h, c): f"round(ln({_weight_sql(h, c)} * n_{h}_{c} + 1.0) + coalesce(sum(tf * ln(({_weight_sql(h, c)} * coalesce(t_{h}_{c}, 0) + 1.0) / "
               f"({_weight_sql(h, c)} * s_{h}_{c} + v))), 0.0), 9) AS l_{h}_{c}" for h, c, _ in _HEADS}
_ARG3 = "CASE WHEN {0}_0 >= {0}_1 AND {0}_0 >= {0}_2 THEN 0 WHEN {0}_1 >= {0}_2 THEN 1 ELSE 2 END"
_SN = "list_extract(['negative', 'neutral', 'positive'], {} + 1)"
O["m21_count_predictions"] = f"""WITH d AS ({O['m0_load_labels']}), sp AS (SELECT doc_id, split FROM ({O['m1_stratified_split']})),
x AS (SELECT row_number() OVER () AS rid, d.*, split FROM d JOIN sp USING (doc_id)),
tok AS (SELECT rid, split, {', '.join(sorted({h for h, _, _ in _HEADS}))}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM x),
ct AS (SELECT term, {', '.join(f'CAST(count_if({h} = {c}) AS DOUBLE) AS t_{h}_{c}' for h, c, _ in _HEADS)} FROM tok WHERE split = 'train' GROUP BY term),
tt AS (SELECT {', '.join(f'sum(t_{h}_{c}) AS s_{h}_{c}' for h, c, _ in _HEADS)}, CAST(count(*) AS DOUBLE) AS v FROM ct),
dc AS (SELECT {', '.join(f'CAST(count_if({h} = {c}) AS DOUBLE) AS n_{h}_{c}' for h, c, _ in _HEADS)}, CAST(count(*) AS DOUBLE) AS n_all FROM x WHERE split = 'train'),
te AS (SELECT rid, term, count(*) AS tf FROM tok WHERE split = 'test' GROUP BY ALL),
ll AS (SELECT rid, {', '.join(_LL.values())} FROM (SELECT rid FROM x WHERE split = 'test') LEFT JOIN te USING (rid) LEFT JOIN ct USING (term), tt, dc GROUP BY ALL)
SELECT doc_id, {_SN.format('sentiment_code')} AS sentiment_label, {_SN.format('(' + _ARG3.format('l_sentiment_code') + ')')} AS sentiment_pred,
 {', '.join(f"em__{e} AS emotion__{e}_label, CAST(l_em__{e}_1 >= l_em__{e}_0 AS INTEGER) AS emotion__{e}_pred" for e in NAMES)},
 {', '.join(f"int__{e} + 1 AS intensity__{e}_label, {_ARG3.format(f'l_int__{e}')} + 1 AS intensity__{e}_pred" for e in NAMES)}
FROM x JOIN ll USING (rid)"""
O["m21_count_predictions"] = O["m21_count_predictions"].replace("FROM (SELECT rid FROM x WHERE split = 'test') LEFT JOIN te USING (rid) LEFT JOIN ct USING (term), tt, dc GROUP BY ALL",
    "FROM (SELECT * FROM (SELECT rid FROM x WHERE split = 'test') LEFT JOIN te USING (rid) LEFT JOIN ct USING (term)) CROSS JOIN tt CROSS JOIN dc GROUP BY rid, tt.*, dc.*".replace(", tt.*, dc.*", "".join(f", s_{h}_{c}, n_{h}_{c}" for h, c, _ in _HEADS) + ", v, n_all"))


# ---------------------------------------------------------------- N4-N9 as standalone column functions
from affect.functions import clean as C  # noqa: E402

Q["n4_sentiment_code"] = lambda spark, sf: _raw(spark, sf).select("doc_id", C.sentiment_code("sentiment").alias("code"))
O["n4_sentiment_code"] = R + f"SELECT doc_id, {S.sentiment_code('sentiment')} AS code FROM labels_raw"

Q["n5_to_flag"] = lambda spark, sf: _raw(spark, sf).select(
    "doc_id", C.to_flag("emotion__joy", "joy").alias("joy"), C.to_flag("emotion__anger", "anger").alias("anger"))
O["n5_to_flag"] = R + f"SELECT doc_id, {S.to_flag('emotion__joy', 'joy')} AS joy, {S.to_flag('emotion__anger', 'anger')} AS anger FROM labels_raw"

Q["n6_intensity_class"] = lambda spark, sf: _raw(spark, sf).select(
    "doc_id", C.intensity_class("intensity__joy").alias("joy"), C.intensity_class("intensity__anger").alias("anger"))
O["n6_intensity_class"] = R + f"SELECT doc_id, {S.intensity_class('intensity__joy')} AS joy, {S.intensity_class('intensity__anger')} AS anger FROM labels_raw"

Q["n7_repair_text"] = lambda spark, sf: C.repair_text(_raw(spark, sf).select("doc_id", "augmented", "original"),
                                                      "augmented").select("doc_id", "augmented")
O["n7_repair_text"] = LOADED + "SELECT doc_id, text AS augmented FROM p"


def _n8(spark, sf):
    """N8 defaulting: sentiment absent -> 'neutral' (one-hot), null -> 'negative'
    (augmentation); empty bundle -> neutral:2 (bundle key)."""
    u = view(spark, "utterances", sf)
    keyed = L.with_bundle_key(u).select("utt_id", F.coalesce("sentiment", F.lit("negative")).alias("aug_sentiment"), "bundle_key")
    return keyed.select("utt_id", F.lit("neutral").alias("sentiment"), "aug_sentiment", "bundle_key")


Q["n8_defaults"] = _n8
O["n8_defaults"] = cte("utterances") + ", b AS (SELECT utt_id, list_filter([" + ", ".join(
    f"{{'e': {S.lenient(e)}, 'i': {S.to_num(i)}}}" for e, i in L.SLOTS) + \
    "], lambda x: x.e IS NOT NULL AND x.i IS NOT NULL) AS bundle FROM utterances)\n" \
    "SELECT u.utt_id, 'neutral' AS sentiment, coalesce(u.sentiment, 'negative') AS aug_sentiment, " \
    "CASE WHEN len(bundle)=0 THEN 'neutral:2' ELSE array_to_string(list_sort(list_transform(bundle, " \
    "lambda x: x.e || ':' || CAST(CAST(trunc(x.i) AS INTEGER) AS VARCHAR))), '|') END AS bundle_key " \
    "FROM utterances u JOIN b USING (utt_id)"


def _n9(spark, sf):
    u = view(spark, "utterances", sf).withColumn("conversation", F.col("domain")) \
        .withColumn("utterance", F.when(F.col("turn") % 2 == 0, F.col("utterance")).otherwise(F.lit("")))
    return u.select("utt_id", C.canonical_text(u).alias("text"))


Q["n9_canonical_text"] = _n9
O["n9_canonical_text"] = cte("utterances") + """SELECT utt_id, coalesce(CASE WHEN turn % 2 = 0 AND utterance <> '' THEN utterance END,
 CASE WHEN domain <> '' THEN domain END, '') AS text FROM utterances"""

"""Registered evaluation queries (M4-M20) over the ``predictions``,
``scores``, ``history`` and ``results`` adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from affect.operators import evaluate as E
from affect.operators import prepare as M
from affect.sources.fixtures import PRED_EMOTIONS, SCORE_EMOTIONS, cte, view

Q: dict = {}
O: dict = {}
K = len(SCORE_EMOTIONS)


def _r6(df):
    """Round every double column to 6 dp (oracle comparison convention)."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pred(spark, sf):
    return view(spark, "predictions", sf)


def _scores(spark, sf):
    return view(spark, "scores", sf)


# ---------------------------------------------------------------- DuckDB helpers
def report_sql(long_cte: str, keys: list[str], classes: list | None, names: dict | None = None,
               p: str = "") -> str:
    """DuckDB text of a classification report over (keys, y_true, y_pred);
    CTE names are prefixed by ``p`` (the result is ``{p}rep``, with the
    class-order column ``ord``)."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    if classes is None:
        grid = f"SELECT DISTINCT {kc}cls FROM (SELECT {kc}y_true AS cls FROM {long_cte} UNION ALL SELECT {kc}y_pred FROM {long_cte})"
    else:
        vals = ", ".join(f"({c!r})" if isinstance(c, str) else f"({c})" for c in classes)
        grid = f"SELECT DISTINCT {kc}v.cls FROM {long_cte}, (VALUES {vals}) v(cls)"
    nm = "CAST(cls AS VARCHAR)"
    if names:
        nm = "CASE " + " ".join(f"WHEN cls = {kk!r} THEN '{vv}'" if isinstance(kk, str) else f"WHEN cls = {kk} THEN '{vv}'"
                                for kk, vv in names.items()) + " ELSE CAST(cls AS VARCHAR) END"
    on = " AND ".join([f"g.{x} = l.{x}" for x in keys] + ["1=1"])
    gk = "".join(f"g.{x}, " for x in keys)
    return f"""
{p}grid AS ({grid}),
{p}cnt AS (SELECT {gk}g.cls, count_if(l.y_true = g.cls) AS support, count_if(l.y_pred = g.cls) AS predicted,
        count_if(l.y_true = g.cls AND l.y_pred = g.cls) AS tp
        FROM {p}grid g JOIN {long_cte} l ON {on} GROUP BY ALL),
{p}m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
        CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM {p}cnt),
{p}agg AS (SELECT {kc}sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
        sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM {p}m GROUP BY ALL),
{p}rep AS (
 SELECT {kc}1 AS pos, cls AS ord, {nm} AS label, precision, recall, f1, support FROM {p}m
 UNION ALL SELECT {kc}2, NULL, 'accuracy', NULL, NULL, CASE WHEN n > 0 THEN tp / n ELSE 0.0 END, n FROM {p}agg
 UNION ALL SELECT {kc}3, NULL, 'macro avg', mp, mr, mf, n FROM {p}agg
 UNION ALL SELECT {kc}4, NULL, 'weighted avg', CASE WHEN n > 0 THEN wp / n ELSE 0.0 END,
   CASE WHEN n > 0 THEN wr / n ELSE 0.0 END, CASE WHEN n > 0 THEN wf / n ELSE 0.0 END, n FROM {p}agg)
"""


def _rep_select(keys):
    kc = (", ".join(keys) + ", ") if keys else ""
    return (f"SELECT {kc}CAST(pos AS INTEGER) AS pos, label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
            f"round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep")


P = cte("predictions")
EM_LONG = "em AS (" + " UNION ALL ".join(
    f"SELECT '{e}' AS emotion, emotion__{e}_label AS y_true, emotion__{e}_pred AS y_pred FROM predictions"
    for e in PRED_EMOTIONS) + ")"
INT_LONG = "it AS (" + " UNION ALL ".join(
    f"SELECT '{e}' AS emotion, intensity__{e}_label - 1 AS y_true, intensity__{e}_pred - 1 AS y_pred FROM predictions"
    for e in PRED_EMOTIONS) + ")"
SENT_LONG = "sl AS (SELECT 'sentiment' AS task, sentiment_label AS y_true, sentiment_pred AS y_pred FROM predictions)"

# ---------------------------------------------------------------- M4-M6
Q["m4_m6_decode"] = lambda spark, sf: _scores(spark, sf).select(
    "vec_id", E.decode_argmax("sentiment_logits").alias("sentiment_pred"),
    F.array_join(E.decode_multilabel("emotion_logits", **E.TRAIN_RULE), ",").alias("emotion_pred_train"),
    F.array_join(E.decode_multilabel("emotion_logits", **E.EVAL_RULE), ",").alias("emotion_pred_eval"),
    F.array_join(E.decode_intensity("intensity_logits", K), ",").alias("intensity_pred"))
_S = cte("scores")
O["m4_m6_decode"] = _S + """, d AS (SELECT *, list_transform(emotion_logits, lambda x: 1.0 / (1.0 + exp(-x))) AS p FROM scores),
h AS (SELECT *, list_transform(p, lambda x: CASE WHEN x >= 0.4 THEN 1 ELSE 0 END) AS h4,
        list_transform(p, lambda x: CASE WHEN x >= 0.5 THEN 1 ELSE 0 END) AS h5,
        list_position(p, list_max(p)) AS top FROM d)
SELECT vec_id, CAST(list_position(sentiment_logits, list_max(sentiment_logits)) - 1 AS INTEGER) AS sentiment_pred,
 array_to_string(CASE WHEN list_sum(h4) > 0 THEN h4 ELSE list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = top THEN 1 ELSE 0 END) END, ',') AS emotion_pred_train,
 array_to_string(h5, ',') AS emotion_pred_eval,
 array_to_string(list_transform(range(0, """ + str(K) + """), lambda j: list_position(intensity_logits[3*j+1:3*j+3], list_max(intensity_logits[3*j+1:3*j+3])) - 1), ',') AS intensity_pred
FROM h"""

# ---------------------------------------------------------------- M7
def _m7a(spark, sf):
    s = _scores(spark, sf)
    w = M.class_weights(s, "sentiment_true", [0, 1, 2])
    return _r6(E.cross_entropy(s, "sentiment_logits", "sentiment_true", w))


_NLL_S = ("(list_max(sentiment_logits) + ln(list_sum(list_transform(sentiment_logits, lambda x: exp(x - list_max(sentiment_logits))))) "
          "- sentiment_logits[sentiment_true + 1])")
_CW = """cw AS (SELECT k.c AS sentiment_true, coalesce((SELECT count(*) FROM scores) / (3.0 * n.cnt), 1.0) AS w
  FROM (VALUES (0), (1), (2)) k(c) LEFT JOIN (SELECT sentiment_true, count(*) AS cnt FROM scores GROUP BY 1) n ON n.sentiment_true = k.c)"""
Q["m7a_cross_entropy"] = _m7a
O["m7a_cross_entropy"] = _S + f", {_CW}\nSELECT round(sum(w * {_NLL_S}) / sum(w), 6) AS loss FROM scores JOIN cw USING (sentiment_true)"


def _m7b(spark, sf):
    s = _scores(spark, sf)
    return _r6(E.focal_loss(s, "emotion_logits", "emotion_true", E.inverse_frequency(s, "emotion_true")))


_FOCAL = _S + """, e AS (SELECT u.pos, u.x, u.t FROM scores, LATERAL (SELECT unnest(range(0, len(emotion_logits))) AS pos,
   unnest(emotion_logits) AS x, CAST(unnest(emotion_true) AS DOUBLE) AS t) u),
al AS (SELECT pos, 1.0 / (avg(t) + 1e-6) AS alpha FROM e GROUP BY pos),
b AS (SELECT alpha, greatest(x, 0.0) - x * t + ln(1 + exp(-abs(x))) AS bce FROM e JOIN al USING (pos))
"""
Q["m7b_focal_loss"] = _m7b
O["m7b_focal_loss"] = _FOCAL + "SELECT round(avg(alpha * pow(1.0 - exp(-bce), 2.0) * bce), 6) AS loss FROM b"

Q["m7c_intensity_loss"] = lambda spark, sf: _r6(E.intensity_loss(_scores(spark, sf), "intensity_logits", "intensity_true", K))
_INTL = _S + """, il AS (SELECT j, (list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) - s[y + 1]) AS nll
  FROM (SELECT u.j, intensity_logits[3*u.j+1:3*u.j+3] AS s, intensity_true[u.j+1] AS y
        FROM scores, LATERAL (SELECT unnest(range(0, """ + str(K) + """)) AS j) u))
"""
O["m7c_intensity_loss"] = _INTL + "SELECT round(avg(l), 6) AS loss FROM (SELECT j, avg(nll) AS l FROM il GROUP BY j)"


def _m7d(spark, sf):
    s = _scores(spark, sf)
    parts = {"sentiment": E.cross_entropy(s, "sentiment_logits", "sentiment_true",
                                          M.class_weights(s, "sentiment_true", [0, 1, 2])),
             "emotion": E.focal_loss(s, "emotion_logits", "emotion_true", E.inverse_frequency(s, "emotion_true")),
             "intensity": E.intensity_loss(s, "intensity_logits", "intensity_true", K)}
    return _r6(E.multitask_loss(parts))


Q["m7d_multitask_loss"] = _m7d
O["m7d_multitask_loss"] = _S + f""", {_CW},
e AS (SELECT u.pos, u.x, u.t FROM scores, LATERAL (SELECT unnest(range(0, len(emotion_logits))) AS pos,
   unnest(emotion_logits) AS x, CAST(unnest(emotion_true) AS DOUBLE) AS t) u),
al AS (SELECT pos, 1.0 / (avg(t) + 1e-6) AS alpha FROM e GROUP BY pos),
b AS (SELECT alpha, greatest(x, 0.0) - x * t + ln(1 + exp(-abs(x))) AS bce FROM e JOIN al USING (pos)),
il AS (SELECT j, (list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) - s[y + 1]) AS nll
  FROM (SELECT u.j, intensity_logits[3*u.j+1:3*u.j+3] AS s, intensity_true[u.j+1] AS y
        FROM scores, LATERAL (SELECT unnest(range(0, {K})) AS j) u))
SELECT round(1.0 * (SELECT sum(w * {_NLL_S}) / sum(w) FROM scores JOIN cw USING (sentiment_true))
 + 1.0 * (SELECT avg(alpha * pow(1.0 - exp(-bce), 2.0) * bce) FROM b)
 + 0.7 * (SELECT avg(l) FROM (SELECT j, avg(nll) AS l FROM il GROUP BY j)), 6) AS loss"""

H = cte("history")
Q["m7d_epoch_loss"] = lambda spark, sf: _r6(E.epoch_loss(view(spark, "history", sf)))
O["m7d_epoch_loss"] = H + "SELECT run_id, epoch, split, round(avg(loss), 6) AS loss, count(*) AS batches FROM history GROUP BY ALL"

# ---------------------------------------------------------------- M8-M11
Q["m8_metrics"] = lambda spark, sf: _r6(E.metrics(_pred(spark, sf), PRED_EMOTIONS))
O["m8_metrics"] = P + ", " + SENT_LONG + ", " + report_sql("sl", ["task"], None) + ", " + EM_LONG + ", " + INT_LONG + """
SELECT round((SELECT f1 FROM rep WHERE label = 'accuracy'), 6) AS sent_acc,
 round((SELECT f1 FROM rep WHERE label = 'macro avg'), 6) AS sent_f1,
 round((SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM em), 6) AS em_f1_micro,
 round((SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM it), 6) AS int_acc"""

Q["m9_sentiment_report"] = lambda spark, sf: _r6(E.classification_report(E.sentiment_long(_pred(spark, sf)), ["task"]))
O["m9_sentiment_report"] = P + ", " + SENT_LONG + ", " + report_sql("sl", ["task"], None) + _rep_select(["task"])

Q["m10_emotion_overall"] = lambda spark, sf: _r6(E.emotion_report(_pred(spark, sf), PRED_EMOTIONS)[0])
O["m10_emotion_overall"] = P + ", " + EM_LONG + ", fl AS (SELECT 'all' AS scope, y_true, y_pred FROM em), " + \
    report_sql("fl", ["scope"], [0, 1]) + """SELECT round(max(CASE WHEN label = 'accuracy' THEN f1 END), 6) AS micro_f1,
 round(max(CASE WHEN label = 'macro avg' THEN f1 END), 6) AS macro_f1,
 round(max(CASE WHEN label = 'accuracy' THEN f1 END), 6) AS accuracy FROM rep"""

Q["m10_emotion_report"] = lambda spark, sf: _r6(E.emotion_report(_pred(spark, sf), PRED_EMOTIONS)[1])
O["m10_emotion_report"] = P + ", " + EM_LONG + ", " + report_sql("em", ["emotion"], [0, 1], {0: "absent", 1: "present"}) + \
    _rep_select(["emotion"])

Q["m11_intensity_overall"] = lambda spark, sf: _r6(E.intensity_report(_pred(spark, sf), PRED_EMOTIONS)[0])
O["m11_intensity_overall"] = P + ", " + INT_LONG + \
    "\nSELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM it"

Q["m11_intensity_report"] = lambda spark, sf: _r6(E.intensity_report(_pred(spark, sf), PRED_EMOTIONS)[1])
O["m11_intensity_report"] = P + ", " + INT_LONG + ", " + report_sql(
    "it", ["emotion"], [0, 1, 2], dict(enumerate(E.INTENSITY_CLASSES))) + _rep_select(["emotion"])

# ---------------------------------------------------------------- M12-M15
Q["m12_predictions_table"] = lambda spark, sf: E.predictions_table(_scores(spark, sf), SCORE_EMOTIONS)
_cols = ["vec_id", "(['negative','neutral','positive'])[sentiment_true + 1] AS sentiment_label",
         "(['negative','neutral','positive'])[list_position(sentiment_logits, list_max(sentiment_logits))] AS sentiment_pred"]
for _j, _e in enumerate(SCORE_EMOTIONS):
    _cols += [f"emotion_true[{_j + 1}] AS emotion__{_e}_label",
              f"CAST(CASE WHEN 1.0 / (1.0 + exp(-emotion_logits[{_j + 1}])) >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS emotion__{_e}_pred"]
for _j, _e in enumerate(SCORE_EMOTIONS):
    _sl = f"intensity_logits[{3 * _j + 1}:{3 * _j + 3}]"
    _cols += [f"intensity_true[{_j + 1}] + 1 AS intensity__{_e}_label",
              f"CAST(list_position({_sl}, list_max({_sl})) AS INTEGER) AS intensity__{_e}_pred"]
O["m12_predictions_table"] = _S + "SELECT " + ", ".join(_cols) + " FROM scores"

Q["m13_sentiment_confusion"] = lambda spark, sf: _r6(E.confusion_matrix(
    E.sentiment_long(_pred(spark, sf)), [], E.SENTIMENT_CLASSES))
_SC = ", ".join(f"('{c}')" for c in E.SENTIMENT_CLASSES)
O["m13_sentiment_confusion"] = P + ", " + SENT_LONG + f""",
g AS (SELECT t.c AS y_true, p.c AS y_pred FROM (VALUES {_SC}) t(c), (VALUES {_SC}) p(c)),
c AS (SELECT y_true, y_pred, count(*) AS cnt FROM sl GROUP BY ALL),
j AS (SELECT g.y_true, g.y_pred, coalesce(c.cnt, 0) AS count FROM g LEFT JOIN c USING (y_true, y_pred))
SELECT y_true, y_pred, count, round(CASE WHEN sum(count) OVER (PARTITION BY y_true) > 0
  THEN count / sum(count) OVER (PARTITION BY y_true) END, 6) AS row_normalised FROM j"""

Q["m14_emotion_performance"] = lambda spark, sf: _r6(E.emotion_performance(_pred(spark, sf), PRED_EMOTIONS))
O["m14_emotion_performance"] = P + ", " + EM_LONG + """, g AS (SELECT emotion, count_if(y_true=1 AND y_pred=1) AS tp,
 count_if(y_true<>1 AND y_pred=1) AS fp, count_if(y_true=1 AND y_pred<>1) AS fn,
 avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CAST(y_true AS DOUBLE)) AS presence_rate FROM em GROUP BY 1)
SELECT emotion, round(CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END, 6) AS f1,
 round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0 END, 6) AS precision,
 round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0.0 END, 6) AS recall,
 round(accuracy, 6) AS accuracy, round(presence_rate, 6) AS presence_rate FROM g ORDER BY f1 DESC, emotion"""


def _m15(spark, sf):
    long = E.intensity_long(_pred(spark, sf), PRED_EMOTIONS, zero_based=False)
    return _r6(E.confusion_matrix(long, ["emotion"], [1, 2, 3]))


Q["m15_intensity_confusion"] = _m15
O["m15_intensity_confusion"] = P + ", " + INT_LONG.replace(" - 1", "") + """,
g AS (SELECT DISTINCT emotion, t.c AS y_true, p.c AS y_pred FROM it, (VALUES (1),(2),(3)) t(c), (VALUES (1),(2),(3)) p(c)),
c AS (SELECT emotion, y_true, y_pred, count(*) AS cnt FROM it WHERE y_true IN (1,2,3) AND y_pred IN (1,2,3) GROUP BY ALL),
j AS (SELECT g.emotion, g.y_true, g.y_pred, coalesce(c.cnt, 0) AS count FROM g LEFT JOIN c USING (emotion, y_true, y_pred))
SELECT emotion, CAST(y_true AS INTEGER) AS y_true, CAST(y_pred AS INTEGER) AS y_pred, count,
 round(CASE WHEN sum(count) OVER (PARTITION BY emotion, y_true) > 0
  THEN count / sum(count) OVER (PARTITION BY emotion, y_true) END, 6) AS row_normalised FROM j"""

# ---------------------------------------------------------------- M16, M17, M20
def _epochs(spark, sf):
    return E.epoch_loss(view(spark, "history", sf)).drop("batches")


Q["m16_history_table"] = lambda spark, sf: _r6(E.history_table(_epochs(spark, sf)))
_EP = H + ", ep AS (SELECT run_id, epoch, split, avg(loss) AS loss FROM history GROUP BY ALL)\n"
O["m16_history_table"] = _EP + """SELECT run_id, epoch, round(max(CASE WHEN split='train' THEN loss END), 6) AS train_loss,
 round(max(CASE WHEN split='val' THEN loss END), 6) AS val_loss FROM ep GROUP BY ALL"""

Q["m17_best_epoch"] = lambda spark, sf: E.best_epoch(_epochs(spark, sf).where(F.col("split") == "val"), patience=2)
_BEST = _EP + """, v AS (SELECT run_id, epoch, loss, min(loss) OVER (PARTITION BY run_id ORDER BY epoch
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ep WHERE split = 'val'),
i AS (SELECT *, max(CASE WHEN pm IS NULL OR loss < pm THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bsf FROM v),
s AS (SELECT *, (epoch - bsf) >= 2 AS stop FROM i),
st AS (SELECT run_id, coalesce(min(CASE WHEN stop THEN epoch END), max(epoch)) AS se FROM s GROUP BY run_id),
best AS (SELECT s.run_id, s.bsf AS best_epoch, s.epoch AS stopped_at, s.stop AS early_stopped
  FROM s JOIN st ON s.run_id = st.run_id AND s.epoch = st.se)
"""
O["m17_best_epoch"] = _BEST + "SELECT * FROM best"

Q["m20_run_summary"] = lambda spark, sf: _r6(E.run_summary(_epochs(spark, sf), patience=2))
O["m20_run_summary"] = _BEST + """SELECT b.run_id, b.best_epoch, round(max(CASE WHEN ep.split='val' THEN ep.loss END), 6) AS best_val_loss,
 round(max(CASE WHEN ep.split='train' THEN ep.loss END), 6) AS train_loss, b.stopped_at, b.early_stopped
FROM best b JOIN ep ON ep.run_id = b.run_id AND ep.epoch = b.best_epoch GROUP BY ALL"""

# ---------------------------------------------------------------- M19
Q["m19_weighted_f1"] = lambda spark, sf: _r6(E.weighted_f1(view(spark, "results", sf), by=["architecture"]))
O["m19_weighted_f1"] = cte("results") + \
    "SELECT architecture, round(sum(f1_score * support) / sum(support), 6) AS weighted_f1 FROM results GROUP BY 1"

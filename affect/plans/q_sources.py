"""Registered source / sink / report queries.

Round-trip queries write a table derived from the test data into a fresh
folder under the shared checkpoint directory and read it back with the
scan under test, so the scan's semantics are checked on real data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from affect.operators import evaluate as E
from affect.operators import labels as L
from affect.operators.prepare import resolve_text_column
from affect.plans.q_evaluate import report_sql
from affect.sources import io as IO
from affect.sources import reports as RP
from affect.sources.fixtures import PRED_EMOTIONS, cte, view

Q: dict = {}
O: dict = {}

_UCOLS = ["utt_id", "domain", "utterance", "sentiment"] + [c for p in L.SLOTS for c in p]


# ---------------------------------------------------------------- S1 / S5
def _csv_roundtrip(spark, sf):
    u = view(spark, "utterances", sf).select(*_UCOLS)
    path = IO.write_table(u, IO.scratch_path(spark, "corpus_csv"), "csv")
    back = IO.read_corpus(spark, path, "csv")
    return back.select(F.col("utt_id").cast("long").alias("utt_id"), *[c for c in _UCOLS if c != "utt_id"])


Q["s1_s5_csv_roundtrip"] = _csv_roundtrip
O["s1_s5_csv_roundtrip"] = cte("utterances") + "SELECT " + ", ".join(_UCOLS) + " FROM utterances"


# ---------------------------------------------------------------- S2
def _drop_malformed(spark, sf):
    raw = view(spark, "labels_raw", sf).select("doc_id", "sentiment", "intensity__joy")
    padded = raw.toDF(" doc_id ", " sentiment", "intensity__joy ")      # header names to be stripped
    path = IO.write_table(padded, IO.scratch_path(spark, "labels_csv"), "csv")
    schema = T.StructType([T.StructField(" doc_id ", T.LongType()), T.StructField(" sentiment", T.StringType()),
                           T.StructField("intensity__joy ", T.IntegerType())])
    return IO.read_corpus(spark, path, "csv", drop_malformed=True, schema=schema, canonical=False, multi_line=False)


Q["s2_drop_malformed"] = _drop_malformed
O["s2_drop_malformed"] = cte("labels_raw") + """SELECT doc_id, sentiment, CAST(intensity__joy AS INTEGER) AS intensity__joy
FROM labels_raw WHERE regexp_full_match(intensity__joy, '-?[0-9]+')"""


# ---------------------------------------------------------------- S9
def _text_columns(spark, sf):
    """The text column of each view, found by name, and how many rows have text in it."""
    rows = None
    for name in ("utterances", "labels_raw", "completions"):
        df = view(spark, name, sf)
        found = resolve_text_column(df.columns, fallback="first")
        part = df.agg(F.count(found).alias("with_text")).select(F.lit(name).alias("view"), F.lit(found).alias("text_column"), "with_text")
        rows = part if rows is None else rows.unionByName(part)
    return rows


Q["s9_text_column"] = _text_columns
O["s9_text_column"] = cte("utterances", "labels_raw", "completions") + """SELECT 'utterances' AS view, 'utterance' AS text_column, count(utterance) AS with_text FROM utterances
UNION ALL SELECT 'labels_raw', 'augmented', count(augmented) FROM labels_raw UNION ALL SELECT 'completions', 'utt_id', count(utt_id) FROM completions"""


# ---------------------------------------------------------------- S4 / S6
def _history_roundtrip(spark, sf):
    ep = E.epoch_loss(view(spark, "history", sf)).drop("batches")
    path = IO.write_documents(IO.history_documents(ep), IO.scratch_path(spark, "history_json"))
    return IO.read_history(spark, path).select("run_id", "split", "epoch", F.round("loss", 6).alias("loss"))


Q["s4_s6_history_roundtrip"] = _history_roundtrip
O["s4_s6_history_roundtrip"] = cte("history") + """SELECT run_id, split, CAST(row_number() OVER (PARTITION BY run_id, split ORDER BY epoch) AS INTEGER) AS epoch,
 round(avg_loss, 6) AS loss FROM (SELECT run_id, split, epoch, avg(loss) AS avg_loss FROM history GROUP BY ALL)"""


def _history_folder(spark, sf):
    """Documents of many runs (a run for every 400 batch ids) in one folder: even runs indented, a folder each and without
    an id of their own; odd runs one line each; some cut in half, some another kind of document."""
    ep = E.epoch_loss(view(spark, "history", sf).withColumn("run_id", F.floor(F.col("batch_id") / 400).cast("int"))).drop("batches")
    docs = IO.history_documents(ep)
    root = IO.scratch_path(spark, "histories")
    fine = docs.where("run_id % 7 not in (3, 5)")
    IO.write_documents(fine.where("run_id % 2 = 0"), f"{root}/indented", folder_by="run_id", indent=True)
    IO.write_documents(fine.where("run_id % 2 = 1"), f"{root}/lines")
    for part, kept, body in (("cut", "run_id % 7 = 3", F.to_json(F.struct("train", "val"), {"pretty": "true"})),
                             ("other", "run_id % 7 = 5", F.to_json(F.struct(F.lit(3).alias("epoch"), F.struct(F.col("val")[0]["loss"].alias("loss")).alias("val_metrics"))))):
        text = F.expr("substr(value, 1, length(value) div 2)") if part == "cut" else F.col("value")
        docs.where(kept).select("run_id", body.alias("value")).select("run_id", text.alias("value")).write.partitionBy("run_id").text(f"{root}/{part}")
    return root


Q["s4_history_documents"] = lambda spark, sf: IO.read_history(spark, _history_folder(spark, sf)).select("run_id", "split", "epoch", F.round("loss", 6).alias("loss"))
_HD = cte("history") + """, ep AS (SELECT CAST(batch_id // 400 AS INTEGER) AS run_id, split, epoch, avg(loss) AS l FROM history GROUP BY ALL)
"""
O["s4_history_documents"] = _HD + """SELECT run_id, split, CAST(row_number() OVER (PARTITION BY run_id, split ORDER BY epoch) AS INTEGER) AS epoch, round(l, 6) AS loss
FROM ep WHERE run_id % 7 NOT IN (3, 5)"""
Q["s4_broken_documents"] = lambda spark, sf: IO.broken_history(spark, _history_folder(spark, sf)).select("run_id", "reason")
O["s4_broken_documents"] = _HD + """SELECT DISTINCT run_id, CASE WHEN run_id % 7 = 3 THEN 'not json' ELSE 'no train or val' END AS reason FROM ep WHERE run_id % 7 IN (3, 5)"""


# ---------------------------------------------------------------- S10 / M18 / S7 / S11
def _pred_runs(spark, sf):
    return view(spark, "predictions", sf).withColumn("run", (F.col("event_id") % 3).cast("int"))


def _intensity_docs(spark, sf):
    p = _pred_runs(spark, sf)
    long = E.intensity_long(p, PRED_EMOTIONS, keep=["run"])
    rep = E.classification_report(long, ["run", "emotion"], [0, 1, 2], dict(enumerate(E.INTENSITY_CLASSES)),
                                  keep_order=True, ordered=False)
    return RP.intensity_report_text(RP.report_lines(rep, ["run", "emotion"]), PRED_EMOTIONS, ["run"])


Q["s10_parse_reports"] = lambda spark, sf: RP.parse_reports(_intensity_docs(spark, sf), "text", ["run"])
_P = cte("predictions")
_IT = "it AS (" + " UNION ALL ".join(
    f"SELECT CAST(event_id % 3 AS INTEGER) AS run, '{e}' AS emotion, {k + 1} AS k, intensity__{e}_label - 1 AS y_true, "
    f"intensity__{e}_pred - 1 AS y_pred FROM predictions" for k, e in enumerate(PRED_EMOTIONS)) + ")"
_WF = _P + ", " + _IT + ", " + report_sql("it", ["run", "emotion"], [0, 1, 2]) + \
    """, wf AS (SELECT rep.run, rep.emotion, CAST(printf('%.4f', rep.f1) AS DOUBLE) AS f1,
  (SELECT min(k) FROM it WHERE it.emotion = rep.emotion) AS pos FROM rep WHERE label = 'weighted avg')
"""
O["s10_parse_reports"] = _WF + "SELECT run, CAST(pos AS INTEGER) AS pos, f1 FROM wf"

Q["m18_mean_weighted_f1"] = lambda spark, sf: E.mean_weighted_f1(
    RP.parse_reports(_intensity_docs(spark, sf), "text", ["run"]), by=["run"])
O["m18_mean_weighted_f1"] = _WF + """SELECT run, round(sum(CAST(round(f1 * 10000) AS BIGINT)) / count(*) / 10000.0, 4) AS mean_weighted_f1,
 count(*) AS n_reports FROM wf GROUP BY run"""


def _report_store(spark, sf):
    docs = _intensity_docs(spark, sf).withColumn("report_ts", F.concat(F.lit("reports_2026010"), F.col("run").cast("string")))
    path = IO.write_table(docs, IO.scratch_path(spark, "reports"), "parquet", partition_by=["report_ts"])
    return spark.read.parquet(path)


Q["s7_latest_report"] = lambda spark, sf: RP.parse_reports(IO.latest_report(_report_store(spark, sf)), "text", ["run"])
O["s7_latest_report"] = _WF + "SELECT run, CAST(pos AS INTEGER) AS pos, f1 FROM wf WHERE run = (SELECT max(run) FROM wf)"


def _summary(spark, sf):
    p = _pred_runs(spark, sf)
    sent = E.classification_report(p.select("run", F.col("sentiment_label").alias("y_true"),
                                            F.col("sentiment_pred").alias("y_pred")), ["run"], keep_order=True, ordered=False)
    sent_txt = RP.report_lines(sent, ["run"]).select("run", F.lit("sentiment").alias("kind"), F.col("report").alias("text"))
    em = E.classification_report(E.emotion_long(p, PRED_EMOTIONS, keep=["run"]), ["run", "emotion"], [0, 1],
                                 {0: "absent", 1: "present"}, keep_order=True, ordered=False)
    em_txt = (RP.report_lines(em, ["run", "emotion"]).groupBy("run")
              .agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("--- "), F.upper("emotion"), F.lit(" ---\n"),
                                                                      F.col("report")))), "\n").alias("text"))
              .select("run", F.lit("emotion").alias("kind"), "text"))
    int_txt = _intensity_docs(spark, sf).select("run", F.lit("intensity").alias("kind"), "text")
    return RP.assemble_summary(sent_txt.unionByName(em_txt).unionByName(int_txt), ["run"])


Q["s11_assemble_summary"] = _summary


# ---------------------------------------------------------------- S11 oracle: the same rendering in DuckDB
def _render_sql(rep: str, keys: list[str], out: str) -> str:
    k = ", ".join(keys)
    num = lambda c: f"lpad(printf('%.4f', {c}), 9, ' ')"
    line = (f"CASE WHEN label = 'accuracy' THEN lpad(label, w, ' ') || ' ' || ' ' || repeat(' ', 9) || ' ' || repeat(' ', 9)"
            f" || ' ' || {num('f1')} || ' ' || lpad(CAST(support AS VARCHAR), 9, ' ') ELSE lpad(label, w, ' ') || ' ' || ' ' || "
            f"{num('precision')} || ' ' || {num('recall')} || ' ' || {num('f1')} || ' ' || lpad(CAST(support AS VARCHAR), 9, ' ') END")
    return f""",
{out}_w AS (SELECT *, CAST(greatest(max(length(label)) OVER (PARTITION BY {k}), 12) AS INTEGER) AS w FROM {rep}),
{out}_l AS (SELECT *, {line} AS line FROM {out}_w),
{out} AS (SELECT {k}, repeat(' ', w) || ' ' || lpad('precision', 10, ' ') || lpad('recall', 10, ' ') || lpad('f1-score', 10, ' ')
   || lpad('support', 10, ' ') || chr(10) || chr(10) || string_agg(CASE WHEN pos = 1 THEN line END, chr(10) ORDER BY ord)
   || chr(10) || chr(10) || string_agg(CASE WHEN pos > 1 THEN line END, chr(10) ORDER BY pos) || chr(10) AS report
  FROM {out}_l GROUP BY {k}, w)"""


_RULE = "'" + "=" * 60 + "'"
_SL = ("sl AS (SELECT CAST(event_id % 3 AS INTEGER) AS run, sentiment_label AS y_true, sentiment_pred AS y_pred "
       "FROM predictions)")
_EL = "el AS (" + " UNION ALL ".join(
    f"SELECT CAST(event_id % 3 AS INTEGER) AS run, '{e}' AS emotion, emotion__{e}_label AS y_true, "
    f"emotion__{e}_pred AS y_pred FROM predictions" for e in PRED_EMOTIONS) + ")"
_NL = "chr(10)"
O["s11_assemble_summary"] = (
    _P + ", " + _IT + ", " + _SL + ", " + _EL + ", "
    + report_sql("sl", ["run"], None, None, p="s_") + ", "
    + report_sql("el", ["run", "emotion"], [0, 1], {0: "absent", 1: "present"}, p="e_") + ", "
    + report_sql("it", ["run", "emotion"], [0, 1, 2], dict(enumerate(E.INTENSITY_CLASSES)), p="i_")
    + _render_sql("s_rep", ["run"], "s_txt") + _render_sql("e_rep", ["run", "emotion"], "e_txt")
    + _render_sql("i_rep", ["run", "emotion"], "i_txt") + f""",
e_doc AS (SELECT run, string_agg(x, {_NL} ORDER BY x) AS text FROM
  (SELECT run, '--- ' || upper(emotion) || ' ---' || {_NL} || report AS x FROM e_txt) GROUP BY run),
i_acc AS (SELECT run, emotion, min(k) AS k, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc FROM it GROUP BY ALL),
i_all AS (SELECT run, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc FROM it GROUP BY run),
i_doc AS (SELECT t.run, {_RULE} || {_NL} || 'INTENSITY CLASSIFICATION REPORT' || {_NL} || {_RULE} || {_NL} || {_NL}
   || 'Overall Intensity Accuracy: ' || printf('%.4f', any_value(o.acc)) || {_NL} || {_NL} || {_RULE} || {_NL}
   || 'PER-EMOTION INTENSITY REPORTS' || {_NL} || {_RULE} || {_NL} || {_NL}
   || string_agg({_NL} || '--- ' || upper(t.emotion) || ' ---' || {_NL} || 'Accuracy: ' || printf('%.4f', a.acc) || {_NL} || {_NL}
      || t.report || {_NL}, '' ORDER BY a.k) AS text
  FROM i_txt t JOIN i_acc a USING (run, emotion) JOIN i_all o USING (run) GROUP BY t.run)
SELECT s.run, {_RULE} || {_NL} || 'FINAL RESULTS SUMMARY' || {_NL} || {_RULE} || {_NL} || {_NL}
  || '--- SENTIMENT CLASSIFICATION ---' || {_NL} || s.report || {_NL} || {_NL}
  || '--- EMOTION CLASSIFICATION (OVERALL) ---' || {_NL} || array_to_string(string_split(e.text, {_NL})[1:10], {_NL}) || {_NL} || {_NL}
  || '--- INTENSITY CLASSIFICATION (OVERALL) ---' || {_NL} || array_to_string(string_split(i.text, {_NL})[1:6], {_NL}) || {_NL}
  || {_NL} || {_RULE} || {_NL} || 'END OF SUMMARY' || {_NL} || {_RULE} AS summary
FROM s_txt s JOIN e_doc e USING (run) JOIN i_doc i USING (run)""")

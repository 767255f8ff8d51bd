"""Text reports: rendering classification reports in the usual fixed-width
layout (4 digits), parsing weighted-F1 values back out of report text
(survey S10) and assembling a readable per-run summary (S11).

Reports are small (one line per class), so rendering is an ordered
``collect_list`` per report; parsing is ``regexp_extract_all`` +
``posexplode`` and works on any number of report documents in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = "=" * 60
WEIGHTED_F1 = r"weighted avg\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)"
HEADERS = ["precision", "recall", "f1-score", "support"]


def _num(c: Column) -> Column:
    return F.lpad(F.format_string("%.4f", c), 9, " ")


def report_lines(rep: DataFrame, keys: list[str]) -> DataFrame:
    """Classification-report rows (keys, pos, label, precision, recall, f1,
    support) -> per key the report text (fixed-width layout), accuracy and support, in one aggregate."""
    within = "__ord" if "__ord" in rep.columns else "label"
    r = F.struct("pos", F.col(within).alias("ord"), "label", "precision", "recall", "f1", "support")
    accuracy = F.col("label") == "accuracy"
    g = rep.groupBy(*keys).agg(F.array_sort(F.collect_list(r)).alias("__l"), F.greatest(F.max(F.length("label")), F.lit(12)).alias("__w"),
                               F.max(F.when(accuracy, F.col("f1"))).alias("accuracy"), F.max(F.when(accuracy, F.col("support"))).alias("support"))

    def line(x: Column) -> Column:
        head, blank = F.lpad(x["label"], F.col("__w"), " "), F.lit(" " + " " * 9)
        tail = F.concat(F.lit(" "), _num(x["f1"]), F.lit(" "), F.lpad(x["support"].cast("string"), 9, " "))
        return F.when(x["label"] == "accuracy", F.concat(head, F.lit(" "), blank, blank, tail)).otherwise(
            F.concat(head, F.lit("  "), _num(x["precision"]), F.lit(" "), _num(x["recall"]), tail))

    header = F.concat(F.lpad(F.lit(""), F.col("__w"), " "), F.lit(" "),
                      *[F.lpad(F.lit(h), 10, " ") for h in HEADERS])
    cls, avg = (F.array_join(F.transform(F.filter("__l", f), line), "\n") for f in (lambda x: x["pos"] == 1, lambda x: x["pos"] > 1))
    return g.select(*keys, F.concat(header, F.lit("\n\n"), cls, F.lit("\n\n"), avg, F.lit("\n")).alias("report"), "accuracy", "support")


def intensity_report_text(per_emotion: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """The intensity report document per ``keys`` (e.g. run): title, overall
    accuracy, then one ``--- EMOTION ---`` block (accuracy + report) per
    emotion in the order of ``order``.  ``per_emotion``: (keys, emotion, report,
    accuracy, support), from which the overall accuracy is summed exactly."""
    place = F.array_position(F.array(*[F.lit(e) for e in order]), F.col("emotion"))
    block = F.concat(F.lit("\n--- "), F.upper("emotion"), F.lit(" ---\nAccuracy: "), F.format_string("%.4f", F.col("accuracy")),
                     F.lit("\n\n"), F.col("report"), F.lit("\n"))
    hits = F.sum(F.round(F.col("accuracy") * F.col("support")))
    g = per_emotion.where(place > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), block.alias("block")))).alias("__b"),
                                                        F.coalesce(hits / F.sum("support"), F.lit(0.0)).alias("accuracy"))
    head = F.concat(F.lit(RULE + "\nINTENSITY CLASSIFICATION REPORT\n" + RULE + "\n\nOverall Intensity Accuracy: "),
                    F.format_string("%.4f", F.col("accuracy")),
                    F.lit("\n\n" + RULE + "\nPER-EMOTION INTENSITY REPORTS\n" + RULE + "\n\n"))
    return g.select(*keys, F.concat(head, F.array_join(F.transform("__b", lambda x: x["block"]), "")).alias("text"))


# ---------------------------------------------------------------- S10
def parse_reports(df: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Every ``weighted avg`` F1 value in report text, in order:
    (keys, pos, f1)."""
    keys = keys or []
    vals = F.regexp_extract_all(F.col(text_col), F.lit(WEIGHTED_F1), 3)
    return (df.select(*keys, F.posexplode(vals).alias("pos", "v"))
              .select(*keys, (F.col("pos") + 1).alias("pos"), F.col("v").cast("double").alias("f1")))


# ---------------------------------------------------------------- S11
def assemble_summary(reports: DataFrame, keys: list[str], kind: str = "kind", text: str = "text",
                     emotion_lines: int = 10, intensity_lines: int = 6) -> DataFrame:
    """Readable summary per run from its report documents (kind in
    sentiment / emotion / intensity): the whole sentiment report, the first
    ``emotion_lines`` lines of the emotion report and the first
    ``intensity_lines`` of the intensity report, each under its header;
    missing reports are skipped."""
    lines = F.split(F.col(text), "\n")
    part = (F.when(F.col(kind) == "sentiment", F.concat(F.lit("--- SENTIMENT CLASSIFICATION ---\n"), F.col(text), F.lit("\n")))
             .when(F.col(kind) == "emotion", F.concat(F.lit("--- EMOTION CLASSIFICATION (OVERALL) ---\n"),
                                                      F.array_join(F.slice(lines, 1, emotion_lines), "\n"), F.lit("\n")))
             .when(F.col(kind) == "intensity", F.concat(F.lit("--- INTENSITY CLASSIFICATION (OVERALL) ---\n"),
                                                        F.array_join(F.slice(lines, 1, intensity_lines), "\n"), F.lit("\n"))))
    order = F.when(F.col(kind) == "sentiment", 1).when(F.col(kind) == "emotion", 2).otherwise(3)
    g = (reports.select(*keys, order.alias("__o"), part.alias("__p")).where(F.col("__p").isNotNull())
                .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__o", "__p"))).alias("__l")))
    body = F.array_join(F.transform("__l", lambda x: x["__p"]), "\n")
    return g.select(*keys, F.concat(F.lit(RULE + "\nFINAL RESULTS SUMMARY\n" + RULE + "\n\n"), body,
                                    F.lit("\n" + RULE + "\nEND OF SUMMARY\n" + RULE)).alias("summary"))

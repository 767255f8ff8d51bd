"""Evaluation over score and prediction tables (survey M4-M20).

Predictions are evaluated in *long* form — (keys, y_true, y_pred) — so one
job evaluates every emotion at once: the wide table is unpivoted with a
narrow ``inline``, reduced to class counts (or confusion cells) by one hash
aggregate (partial aggregation before the shuffle), and every report is
arithmetic on those.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affect.functions.frames import stack_rows

DEFAULT_TASK_WEIGHTS = {"sentiment": 1.0, "emotion": 1.0, "intensity": 0.7}
SENTIMENT_CLASSES = ["negative", "neutral", "positive"]
INTENSITY_CLASSES = ["low (1)", "medium (2)", "high (3)"]


# ---------------------------------------------------------------- decoding
def decode_argmax(col) -> Column:
    """M4: index of the first maximum (0-based)."""
    a = F.col(col) if isinstance(col, str) else col
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sigmoid_array(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def decode_multilabel(col, threshold: float = 0.5, fallback: bool = False) -> Column:
    """M5: sigmoid >= threshold per label.  ``fallback`` (the training rule)
    sets the arg-max label when a row would otherwise be empty."""
    a = F.col(col) if isinstance(col, str) else col
    p = sigmoid_array(a)
    hard = F.transform(p, lambda x: F.when(x >= threshold, 1).otherwise(0))
    if not fallback:
        return hard
    top = F.array_position(p, F.array_max(p))
    forced = F.transform(p, lambda x, i: F.when(i + 1 == top, 1).otherwise(0))
    return F.when(F.exists(hard, lambda x: x == 1), hard).otherwise(forced)


TRAIN_RULE = dict(threshold=0.4, fallback=True)
EVAL_RULE = dict(threshold=0.5, fallback=False)


def decode_intensity(col, k: int) -> Column:
    """M6: reshape 3k logits to k x 3 and arg-max each row."""
    a = F.col(col) if isinstance(col, str) else col
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda j: decode_argmax(F.slice(a, j * 3 + 1, 3)))


# ---------------------------------------------------------------- losses
def _logsumexp(a: Column) -> Column:
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m)))


def nll(logits: Column, label: Column) -> Column:
    """Per-row negative log-likelihood of a softmax over ``logits``."""
    return _logsumexp(logits) - F.element_at(logits, label + 1)


def cross_entropy(df: DataFrame, logits: str, label: str,
                  weights: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Weighted mean cross entropy  sum(w_y * nll) / sum(w_y)  (per
    ``by`` group; unweighted when ``weights`` is None).  ``weights`` is a
    (label, weight) table."""
    by = by or []
    d = df.withColumn("__nll", nll(F.col(logits), F.col(label)))
    if weights is not None:
        d = d.join(weights.select(label, F.col("weight").alias("__w")), on=label, how="left")
        d = d.withColumn("__w", F.coalesce("__w", F.lit(1.0)))
    else:
        d = d.withColumn("__w", F.lit(1.0))
    return d.groupBy(*by).agg((F.sum(F.col("__w") * F.col("__nll")) / F.sum("__w")).alias("loss"))


def bce_with_logits(x: Column, t: Column) -> Column:
    """Numerically stable binary cross entropy on a logit."""
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def focal_loss(df: DataFrame, logits: str, targets: str, alpha,
               gamma: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """Mean over rows x labels of alpha_e (1 - pt)^gamma * BCE with
    pt = exp(-BCE).  ``alpha`` is a per-label list, or a small DataFrame
    (pos, alpha) such as the M3 label weights — joined on the
    label position, so nothing goes through the driver."""
    by = by or []
    e = df.select(*by, F.posexplode(F.arrays_zip(F.col(logits).alias("x"), F.col(targets).alias("t"))))
    e = e.select(*by, "pos", F.col("col.x").alias("x"), F.col("col.t").cast("double").alias("t"))
    if isinstance(alpha, DataFrame):
        e = e.join(alpha.select("pos", "alpha"), on="pos", how="left")
    else:
        e = e.withColumn("alpha", F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), F.col("pos") + 1))
    b = bce_with_logits(F.col("x"), F.col("t"))
    v = F.col("alpha") * F.pow(F.lit(1.0) - F.exp(-b), F.lit(gamma)) * b
    return e.groupBy(*by).agg(F.avg(v).alias("loss"))


def inverse_frequency(df: DataFrame, targets: str) -> DataFrame:
    """M3 on an array column: (pos, frequency, alpha = 1/(freq + 1e-6))."""
    e = df.select(F.posexplode(F.col(targets)))
    return (e.groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("frequency"))
             .withColumn("alpha", F.lit(1.0) / (F.col("frequency") + F.lit(1e-6))))


def intensity_loss(df: DataFrame, logits: str, labels: str, k: int,
                   by: list[str] | None = None) -> DataFrame:
    """Unweighted cross entropy per emotion (3 classes each), averaged
    over rows, then over emotions."""
    by = by or []
    per = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                      lambda j: F.struct(j.alias("j"), nll(F.slice(F.col(logits), j * 3 + 1, 3),
                                                            F.element_at(F.col(labels), j + 1)).alias("nll")))
    e = df.select(*by, F.inline(per))
    return (e.groupBy(*by, "j").agg(F.avg("nll").alias("l"))
             .groupBy(*by).agg(F.avg("l").alias("loss")))


def multitask_loss(parts: dict[str, DataFrame], weights: dict | None = None,
                   by: list[str] | None = None) -> DataFrame:
    """M7d: w_s*L_s + w_e*L_e + w_i*L_i over the tasks present."""
    weights = weights or DEFAULT_TASK_WEIGHTS
    by = by or []
    frames = [p.select(*by, (F.col("loss") * F.lit(weights[t])).alias("loss"), F.lit(t).alias("task"))
              for t, p in parts.items()]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u.groupBy(*by).agg(F.sum("loss").alias("loss"))


def epoch_loss(batches: DataFrame, keys=("run_id", "epoch", "split")) -> DataFrame:
    """M7d: epoch loss = mean of the batch losses."""
    return batches.groupBy(*keys).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


# ---------------------------------------------------------------- confusion cells
def confusion_cells(long: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """(keys, y_true, y_pred, cnt) — the only aggregation over raw rows."""
    return long.groupBy(*keys, y_true, y_pred).agg(F.count(F.lit(1)).alias("cnt"))


def class_counts(long: DataFrame, keys: list[str], classes: list | None = None) -> DataFrame:
    """(keys, cls, support, predicted, tp) in one aggregate: every row counts for its true
    and for its predicted class.  With ``classes`` other labels count for none (class null, no counts)."""
    sides = []
    for c, support, predicted in ((F.col("y_true"), 1, 0), (F.col("y_pred"), 0, 1)):
        known = F.lit(True) if classes is None else F.coalesce(c.isin(*classes), F.lit(False))
        hit = (F.col("y_true") == F.col("y_pred")) if support else F.lit(False)
        sides.append(F.struct(F.when(known, c).alias("cls"), F.when(known, F.lit(support)).otherwise(0).alias("support"),
                              F.when(known, F.lit(predicted)).otherwise(0).alias("predicted"), F.when(known & hit, 1).otherwise(0).alias("tp")))
    rows = long.select(*keys, F.inline(F.array(*sides)))
    return rows.groupBy(*keys, "cls").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def class_metrics(counts: DataFrame) -> DataFrame:
    """precision / recall / f1 per class, zero_division = 0."""
    return (counts.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
                  .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
                  .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def classification_report(long: DataFrame, keys: list[str], classes: list | None = None,
                          names: dict | None = None, y_true: str = "y_true", y_pred: str = "y_pred",
                          keep_order: bool = False, ordered: bool = True) -> DataFrame:
    """M9: per class precision/recall/f1/support plus accuracy, macro avg and
    weighted avg rows, per ``keys`` group.  Rows: (keys, pos, label,
    precision, recall, f1, support); the accuracy row carries only f1.

    One aggregate over the rows, one by grouping sets over the classes (each class, and all of
    a key), and one ``inline`` that makes every report row; ``classes`` that a key does not
    have are rows of zeros (without a list: the observed labels)."""
    if (y_true, y_pred) != ("y_true", "y_pred"):
        long = long.withColumnRenamed(y_true, "y_true").withColumnRenamed(y_pred, "y_pred")
    m = class_metrics(class_counts(long, keys, classes))
    kind = dict(m.dtypes)["cls"]
    mapping = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]) if names else None

    def row(pos: int, order, label, precision, recall, f1, support):
        values = [F.lit(pos), order, label, precision, recall, f1, support]
        types = ["int", "string", "string", "double", "double", "double", "long"]
        fields = ["pos", "__ord", "label", "precision", "recall", "f1", "support"]
        return F.struct(*[v.cast(t).alias(f) for v, t, f in zip(values, types, fields)])

    def of_class(c, precision, recall, f1, support):
        text = c.cast("string")
        order = text if kind == "string" else F.lpad(text, 20, "0")
        return row(1, order, F.coalesce(F.try_element_at(mapping, c), text) if names else text, precision, recall, f1, support)

    weighted = [F.sum(F.col(x) * F.col("support")).alias(f"__w_{x}") for x in ("precision", "recall", "f1")]
    g = m.groupingSets([[*keys, "cls"], keys], *keys, "cls").agg(
        *[F.sum(x).alias(x) for x in ("precision", "recall", "f1", "support", "tp")], *weighted,
        F.count(F.lit(1)).alias("__k"), F.collect_set("cls").alias("__seen"), (F.grouping_id().bitwiseAND(1) == 1).alias("__all"))
    n, k = F.col("support"), F.col("__k") if classes is None else F.lit(len(classes))
    empty, none = F.lit(""), F.lit(None)
    rows = F.array(row(2, empty, F.lit("accuracy"), none, none, _ratio(F.col("tp"), n), n),
                   row(3, empty, F.lit("macro avg"), *[F.col(x) / k for x in ("precision", "recall", "f1")], n),
                   row(4, empty, F.lit("weighted avg"), *[_ratio(F.col(f"__w_{x}"), n) for x in ("precision", "recall", "f1")], n))
    if classes is not None:
        zero = F.lit(0.0)
        unseen = F.array_except(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col("__seen"))
        rows = F.concat(rows, F.transform(unseen, lambda c: of_class(c, zero, zero, zero, F.lit(0))))
    one = F.array(of_class(F.col("cls"), F.col("precision"), F.col("recall"), F.col("f1"), n))
    if classes is not None:
        g = g.where(F.col("__all") | F.col("cls").isNotNull())
    out = g.select(*keys, F.inline(F.when(F.col("__all"), rows).otherwise(one)))
    out = out.orderBy(*keys, "pos", "__ord") if ordered else out
    return out if keep_order else out.drop("__ord")


# ---------------------------------------------------------------- wide -> long
def sentiment_long(pred: DataFrame) -> DataFrame:
    return pred.select(F.lit("sentiment").alias("task"), F.col("sentiment_label").alias("y_true"),
                       F.col("sentiment_pred").alias("y_pred"))


def emotion_long(pred: DataFrame, names: list[str], keep=()) -> DataFrame:
    """(keep..., emotion, y_true, y_pred) from ``emotion__<e>_label/_pred``."""
    return pred.select(*keep, stack_rows(["emotion", "y_true", "y_pred"],
                                  [(e, F.col(f"emotion__{e}_label"), F.col(f"emotion__{e}_pred")) for e in names]))


def intensity_long(pred: DataFrame, names: list[str], zero_based: bool = True, keep=()) -> DataFrame:
    """(keep..., emotion, y_true, y_pred) for intensities; the predictions
    table uses 1..3, evaluation 0..2 (``zero_based`` subtracts one)."""
    off = 1 if zero_based else 0
    return pred.select(*keep, stack_rows(["emotion", "y_true", "y_pred"],
                                  [(e, F.col(f"intensity__{e}_label") - off, F.col(f"intensity__{e}_pred") - off)
                                   for e in names]))


def prediction_names(pred: DataFrame, kind: str = "emotion") -> list[str]:
    """Emotion names from ``<kind>__<e>_label`` columns (schema metadata)."""
    pre, suf = f"{kind}__", "_label"
    return [c[len(pre):-len(suf)] for c in pred.columns if c.startswith(pre) and c.endswith(suf)]


# ---------------------------------------------------------------- M8
def metrics(pred: DataFrame, names: list[str]) -> DataFrame:
    """M8 in one row: sentiment accuracy and macro-F1 over the observed
    classes, flattened emotion micro-F1 (= accuracy over all cells, both
    classes averaged), element-wise intensity accuracy.  All tasks are rows of one report, from one scan."""
    sides = [("sentiment", "sentiment_label", "sentiment_pred")]
    sides += [(kind, f"{kind}__{e}_label", f"{kind}__{e}_pred") for kind in ("emotion", "intensity") for e in names]
    long = pred.select(stack_rows(["task", "y_true", "y_pred"], [(t, F.col(a).cast("string"), F.col(b).cast("string")) for t, a, b in sides]))
    r = classification_report(long.where("task = 'sentiment' or (y_true is not null and y_pred is not null)"), ["task"], ordered=False)

    def value(task: str, label: str):
        return F.max(F.when((F.col("task") == task) & (F.col("label") == label) & (F.col("pos") > 1), F.col("f1")))

    return r.agg(value("sentiment", "accuracy").alias("sent_acc"), value("sentiment", "macro avg").alias("sent_f1"),
                 value("emotion", "accuracy").alias("em_f1_micro"), value("intensity", "accuracy").alias("int_acc"))


# ---------------------------------------------------------------- M10 / M11
def emotion_report(pred: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Overall flattened micro/macro F1 and accuracy, and the per-emotion
    absent/present classification report (one job for all emotions)."""
    long = emotion_long(pred, names)
    flat = classification_report(long.select(F.lit("all").alias("scope"), "y_true", "y_pred"), ["scope"], [0, 1], ordered=False)
    overall = flat.groupBy().agg(
        F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).alias("micro_f1"),
        F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).alias("accuracy"))
    per = classification_report(long, ["emotion"], [0, 1], {0: "absent", 1: "present"})
    return overall, per


def intensity_report(pred: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Overall intensity accuracy, then per emotion accuracy and the
    low/medium/high classification report."""
    long = intensity_long(pred, names)
    overall = long.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    per = classification_report(long, ["emotion"], [0, 1, 2], dict(enumerate(INTENSITY_CLASSES)))
    return overall, per


# ---------------------------------------------------------------- M12
def predictions_table(scores: DataFrame, names: list[str], text_col: str | None = None,
                      tasks=("sentiment", "emotion", "intensity"), id_col: str = "vec_id") -> DataFrame:
    """Decode a score table into the wide predictions table: sentiment
    codes -> names, per emotion label/pred, intensities shifted to 1..3."""
    k = len(names)
    sname = F.array(*[F.lit(s) for s in SENTIMENT_CLASSES])
    cols = [F.col(id_col)] + ([F.col(text_col).alias("text")] if text_col else [])
    em = decode_multilabel("emotion_logits", **EVAL_RULE)
    it = decode_intensity("intensity_logits", k)
    if "sentiment" in tasks:
        cols += [F.element_at(sname, F.col("sentiment_true") + 1).alias("sentiment_label"),
                 F.element_at(sname, decode_argmax("sentiment_logits") + 1).alias("sentiment_pred")]
    if "emotion" in tasks:
        for j, e in enumerate(names):
            cols += [F.element_at("emotion_true", j + 1).alias(f"emotion__{e}_label"),
                     F.element_at(em, j + 1).alias(f"emotion__{e}_pred")]
    if "intensity" in tasks:
        for j, e in enumerate(names):
            cols += [(F.element_at("intensity_true", j + 1) + 1).alias(f"intensity__{e}_label"),
                     (F.element_at(it, j + 1) + 1).alias(f"intensity__{e}_pred")]
    return scores.select(*cols)


# ---------------------------------------------------------------- M13 / M15
def confusion_matrix(long: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """(keys, y_true, y_pred, count, row_normalised) over the
    classes x classes grid; labels outside ``classes`` are ignored, an empty
    true row normalises to null."""
    cells = confusion_cells(long.where(F.col("y_true").isin(*classes) & F.col("y_pred").isin(*classes)), keys)
    lit = F.array(*[F.lit(c) for c in classes])
    grid = (long.select(*keys).distinct() if keys else long.sparkSession.range(1).select())
    grid = grid.select(*keys, F.explode(lit).alias("y_true")).select(*keys, "y_true", F.explode(lit).alias("y_pred"))
    j = grid.join(cells, on=keys + ["y_true", "y_pred"], how="left").na.fill(0, ["cnt"])
    w = Window.partitionBy(*keys, "y_true")
    return j.select(*keys, "y_true", "y_pred", F.col("cnt").alias("count"),
                    F.try_divide(F.col("cnt").cast("double"), F.sum("cnt").over(w)).alias("row_normalised"))


# ---------------------------------------------------------------- M14
def emotion_performance(pred: DataFrame, names: list[str]) -> DataFrame:
    """Per emotion binary (positive class) F1/precision/recall,
    accuracy and presence rate, ordered by F1 descending."""
    long = emotion_long(pred, names)
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    g = long.groupBy("emotion").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        F.avg(F.col("y_true").cast("double")).alias("presence_rate"))
    return (g.select("emotion",
                     _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                     _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                     "accuracy", "presence_rate")
             .orderBy(F.desc("f1"), "emotion"))


# ---------------------------------------------------------------- M16 / M17 / M20
def history_table(epochs: DataFrame, keys=("run_id",)) -> DataFrame:
    """Train vs val per epoch (pivot on split with explicit values);
    columns ``train_<metric>`` / ``val_<metric>``."""
    keys = list(keys)
    metric_cols = [c for c in epochs.columns if c not in keys + ["epoch", "split", "batches"]]
    wide = (epochs.groupBy(*keys, "epoch").pivot("split", ["train", "val"])
                  .agg(*[F.first(c).alias(c) for c in metric_cols]))
    if len(metric_cols) == 1:
        m = metric_cols[0]
        wide = wide.withColumnRenamed("train", f"train_{m}").withColumnRenamed("val", f"val_{m}")
    return wide.orderBy(*keys, "epoch")


def best_epoch(val: DataFrame, patience: int = 2, keys=("run_id",), loss: str = "loss") -> DataFrame:
    """Best epoch = first strict minimum of the validation loss seen up
    to the stopping epoch; training stops at the first epoch whose distance
    to the best-so-far epoch reaches ``patience``.

    One window per run over its epochs (tens of rows): improved = loss below
    every earlier loss; best-so-far = last improved epoch; stop = first epoch
    with epoch - best-so-far >= patience (or the last epoch).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("epoch")
    prev_min = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = (val.withColumn("__improved", prev_min.isNull() | (F.col(loss) < prev_min))
            .withColumn("__best_so_far", F.max(F.when(F.col("__improved"), F.col("epoch"))).over(
                w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("__stop", (F.col("epoch") - F.col("__best_so_far")) >= patience))
    g = d.groupBy(*keys).agg(
        F.min(F.when(F.col("__stop"), F.col("epoch"))).alias("stop_epoch"),
        F.max("epoch").alias("last_epoch"))
    d2 = d.join(g, on=keys).where(F.col("epoch") == F.coalesce(F.col("stop_epoch"), F.col("last_epoch")))
    return d2.select(*keys, F.col("__best_so_far").alias("best_epoch"),
                     F.col("epoch").alias("stopped_at"), F.col("__stop").alias("early_stopped"))


def run_summary(epochs: DataFrame, patience: int = 2, keys=("run_id",)) -> DataFrame:
    """One row per run: best epoch, best val loss and the train/val
    metrics of that epoch, where training stopped and whether early."""
    keys = list(keys)
    val = epochs.where(F.col("split") == "val")
    b = best_epoch(val, patience, keys)
    wide = history_table(epochs, keys)
    metric_cols = [c for c in wide.columns if c not in keys + ["epoch"]]
    return (b.join(wide, on=keys).where(F.col("epoch") == F.col("best_epoch"))
             .select(*keys, "best_epoch", F.col("val_loss").alias("best_val_loss"),
                     *[c for c in metric_cols if c != "val_loss"], "stopped_at", "early_stopped"))


# ---------------------------------------------------------------- M18 / M19
def mean_weighted_f1(parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the parsed per-emotion weighted F1 values (4 dp).  The
    parsed values have 4 decimals, so they are summed exactly as integers
    (ten-thousandths) — the mean does not depend on summation order."""
    ticks = F.round(F.col("f1") * 10000).cast("long")
    return parsed.groupBy(*(by or [])).agg(
        F.round(F.sum(ticks) / F.count(F.lit(1)) / 10000.0, 4).alias("mean_weighted_f1"),
        F.count(F.lit(1)).alias("n_reports"))


def weighted_f1(df: DataFrame, f1: str = "f1_score", support: str = "support",
                by: list[str] | None = None) -> DataFrame:
    """Support-weighted F1 = sum(f1 * support) / sum(support)."""
    return df.groupBy(*(by or [])).agg(
        (F.sum(F.col(f1) * F.col(support)) / F.sum(support)).alias("weighted_f1"))

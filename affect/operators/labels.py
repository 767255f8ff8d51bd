"""Label-structure operators (survey L1-L9): slot arrays, exploded records,
emotion bundles, vocabularies, one-hot conversion and its reverse.

The slot-form corpus has ``emotion1..3`` / ``intensity1..3``; a corpus that
uses the other spelling (``emotion, emotion2, emotion3`` / ``intensity,
intensity2, intensity3``) is mapped in by :func:`canonical_slots`.
Everything is narrow (no shuffle) except the vocabulary, which is a
``distinct`` over at most ``3 * N`` short strings with map-side
de-duplication, bounded by the number of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affect.functions.clean import (finite, intensity_class, normalize_label,
                                    normalize_label_strict, py_strip, to_flag,
                                    to_num)

SLOTS = [("emotion1", "intensity1"), ("emotion2", "intensity2"), ("emotion3", "intensity3")]
_ALT = {"emotion": "emotion1", "intensity": "intensity1"}


def canonical_slots(df: DataFrame) -> DataFrame:
    """Map the single-suffix spelling onto ``emotion1..3``/``intensity1..3``
    and add missing slots as nulls."""
    for src, dst in _ALT.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    for e, i in SLOTS:
        if e not in df.columns:
            df = df.withColumn(e, F.lit(None).cast("string"))
        if i not in df.columns:
            df = df.withColumn(i, F.lit(None).cast("string"))
    return df


# ---------------------------------------------------------------- L1
def with_emotions(df: DataFrame, strict: bool = True) -> DataFrame:
    """L1: ``emotions`` = strictly normalised labels in slot order (duplicates
    kept, rejected labels dropped) and ``num_emotions`` = its size."""
    norm = normalize_label_strict if strict else normalize_label
    arr = F.filter(F.array(*[norm(e) for e, _ in SLOTS]), lambda x: x.isNotNull())
    return df.withColumn("emotions", arr).withColumn("num_emotions", F.size("emotions"))


# ---------------------------------------------------------------- L2
def slot_records(df: DataFrame) -> Column:
    """Array of (slot, emotion, intensity) structs, one per slot, before
    filtering.  ``emotion`` is the lenient label, ``intensity`` the numeric
    coercion of the paired intensity."""
    return F.array(*[
        F.struct(F.lit(k + 1).alias("slot"), normalize_label(e).alias("emotion"),
                 to_num(i).alias("intensity"))
        for k, (e, i) in enumerate(SLOTS)])


def explode_slots(df: DataFrame, keep: list[str] | None = None,
                  require_intensity: bool = True) -> DataFrame:
    """L2: one record per slot whose emotion is non-blank and (by default)
    whose intensity is numeric.  ``keep`` lists passthrough columns."""
    keep = keep if keep is not None else [c for c in df.columns
                                          if c not in {e for e, _ in SLOTS} | {i for _, i in SLOTS}]
    cond = (lambda x: x["emotion"].isNotNull() & x["intensity"].isNotNull()) if require_intensity \
        else (lambda x: x["emotion"].isNotNull())
    return (df.select(*keep, F.explode(F.filter(slot_records(df), cond)).alias("r"))
              .select(*keep, "r.slot", "r.emotion", "r.intensity"))


def sentiment_label(col="sentiment", keep_null: bool = False) -> Column:
    """Lower-cased, stripped sentiment.  A null stays null unless
    ``keep_null`` reproduces the reference's ``'nan'`` string."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.lower(py_strip(c.cast("string")))
    return F.coalesce(v, F.lit("nan")) if keep_null else v


# ---------------------------------------------------------------- L3 / L4
def with_bundle(df: DataFrame) -> DataFrame:
    """L3: ``bundle`` = array<struct<emotion, intensity>> in slot order, slots
    with a blank emotion or a non-numeric intensity skipped."""
    b = F.filter(slot_records(df), lambda x: x["emotion"].isNotNull() & x["intensity"].isNotNull())
    return df.withColumn("bundle", F.transform(
        b, lambda x: F.struct(x["emotion"].alias("emotion"), x["intensity"].alias("intensity"))))


def bundle_key(bundle: Column) -> Column:
    """L4: sorted ``emotion:int(intensity)`` strings joined by ``|``;
    an empty bundle is ``neutral:2``."""
    parts = F.array_sort(F.transform(
        bundle, lambda x: F.concat(x["emotion"], F.lit(":"), x["intensity"].cast("int").cast("string"))))
    return F.when(F.size(bundle) == 0, F.lit("neutral:2")).otherwise(F.array_join(parts, "|"))


def with_bundle_key(df: DataFrame) -> DataFrame:
    if "bundle" not in df.columns:
        df = with_bundle(df)
    return df.withColumn("bundle_key", bundle_key(F.col("bundle")))


# ---------------------------------------------------------------- L5
def vocabulary(df: DataFrame, normalise: bool = True) -> DataFrame:
    """Sorted distinct emotion labels over the three slots (lenient
    normalisation, '' and 'nan' excluded).  ``normalise=False`` keeps the raw
    spelling (only nulls and '' removed)."""
    if normalise:
        labels = [normalize_label(e) for e, _ in SLOTS]
    else:
        labels = [F.when(F.col(e) != "", F.col(e)) for e, _ in SLOTS]
    return (df.select(F.explode(F.array(*labels)).alias("emotion"))
              .where(F.col("emotion").isNotNull() & (F.col("emotion") != "nan"))
              .distinct().orderBy("emotion"))


#: Labels that may become columns.
MOST_COLUMNS = 2000


def collect_vocabulary(df: DataFrame, normalise: bool = True, most: int = MOST_COLUMNS) -> list[str]:
    """Driver-side vocabulary — needed only where it becomes column names
    (one-hot, pivots); more than ``most`` labels are an error (use the long or map forms)."""
    found = [r[0] for r in vocabulary(df, normalise).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} labels: no wide table (see one_hot_map)")
    return found


# ---------------------------------------------------------------- L6
def slot_entries() -> Column:
    """(k, v) of the slots with a label: label and truncated intensity (2 when unparsable)."""
    return F.filter(F.array(*[
        F.struct(normalize_label(e).alias("k"),
                 F.coalesce(finite(i).cast("int"), F.lit(2)).alias("v"))
        for e, i in SLOTS]), lambda x: x["k"].isNotNull() & (x["k"] != "nan"))


def one_hot_map(df: DataFrame, keep: list[str]) -> DataFrame:
    """L6 for any set of labels: ``keep`` and ``labels``, a map from each label of the row to
    (present = 1, intensity of the last slot naming it).  No vocabulary is needed, and no label is lost."""
    e = F.col("__slots")
    last = F.filter(e, lambda x, j: ~F.exists(F.slice(e, j + 2, F.lit(len(SLOTS))), lambda y: y["k"] == x["k"]))
    entries = F.transform(last, lambda x: F.struct(x["k"], F.struct(F.lit(1).alias("present"), x["v"].alias("intensity"))))
    return df.withColumn("__slots", slot_entries()).select(*keep, F.map_from_entries(entries).alias("labels"))


def melt_map(df: DataFrame, id_col: str) -> DataFrame:
    """L7 from the map form: (id, emotion, present, intensity) of every label that a row has."""
    return df.select(id_col, F.explode("labels").alias("emotion", "__v")).select(id_col, "emotion", "__v.present", "__v.intensity")


def one_hot(df: DataFrame, vocab: list[str], text_col: str = "utterance",
            passthrough=("original", "quality", "mode"),
            sentiment_default: str = "neutral", id_col: str | None = "utt_id") -> DataFrame:
    """``emotion__e`` in {0,1} and ``intensity__e`` = truncated intensity of
    the *last* slot naming e (2 when unparsable, 0 when absent).

    No shuffle and no pivot: the three slots form a small per-row array and
    every vocabulary entry is one projection over it (the last matching slot
    wins, as when a Python dict is filled slot by slot).
    """
    df = df.withColumn("__slots", slot_entries())
    cols = [F.col(c) for c in ([id_col] if id_col and id_col in df.columns else [])]
    cols.append(F.col(text_col))
    cols.append(F.col("sentiment") if "sentiment" in df.columns
                else F.lit(sentiment_default).alias("sentiment"))
    for e in vocab:
        hits = F.filter(F.col("__slots"), lambda x: x["k"] == F.lit(e))
        cols.append(F.when(F.size(hits) > 0, 1).otherwise(0).alias(f"emotion__{e}"))
        cols.append(F.coalesce(F.try_element_at(hits, F.lit(-1))["v"], F.lit(0)).alias(f"intensity__{e}"))
    cols += [F.col(c) for c in passthrough if c in df.columns]
    return df.select(*cols)


# ---------------------------------------------------------------- L7
def melt_one_hot(df: DataFrame, vocab: list[str], id_col: str,
                 emotion_fmt: str = "emotion__{}", intensity_fmt: str = "intensity__{}") -> DataFrame:
    """One-hot -> long (id, emotion, present, intensity)."""
    arr = F.array(*[F.struct(F.lit(e).alias("emotion"),
                             F.col(emotion_fmt.format(e)).cast("int").alias("present"),
                             F.col(intensity_fmt.format(e)).cast("int").alias("intensity"))
                    for e in vocab])
    return df.select(id_col, F.inline(arr))


# ---------------------------------------------------------------- L8
def label_arrays(df: DataFrame, vocab: list[str]) -> DataFrame:
    """Ordered label arrays (``emotion_labels``, ``intensity_labels``)."""
    return (df.withColumn("emotion_labels", F.array(*[F.col(f"emotion__{e}") for e in vocab]))
              .withColumn("intensity_labels", F.array(*[F.col(f"intensity__{e}") for e in vocab])))


# ---------------------------------------------------------------- L9
def label_mode(df: DataFrame, emotion_labels: str = "emotion_labels") -> DataFrame:
    """Share of rows with <= 1 emotion; below 0.95 the corpus is
    ``multi-label``, else ``single-emotion``."""
    n_em = F.aggregate(F.col(emotion_labels), F.lit(0), lambda a, x: a + x)
    return (df.agg(F.avg(F.when(n_em <= 1, 1.0).otherwise(0.0)).alias("single_label_ratio"))
              .withColumn("mode", F.when(F.col("single_label_ratio") < 0.95, "multi-label")
                          .otherwise("single-emotion")))


def parse_one_hot(df: DataFrame, vocab: list[str]) -> DataFrame:
    """N5/N6 applied per vocabulary entry: ``em__e`` flag and ``int__e`` class
    (class computed whenever the emotion cell is non-null)."""
    out = df
    for e in vocab:
        ecol, icol = f"emotion__{e}", f"intensity__{e}"
        numeric = dict(df.dtypes).get(ecol, "string") != "string"
        out = out.withColumn(f"em__{e}", to_flag(ecol, e, numeric=numeric))
        ic = intensity_class(icol) if icol in df.columns else F.lit(0)
        out = out.withColumn(f"int__{e}", F.when(F.col(ecol).isNull(), 0).otherwise(ic).cast("int"))
    return out

"""Column-level cleaning and coercion (survey N1-N11).

All helpers return ``Column`` expressions built from Spark built-ins, so they
stay inside whole-stage codegen and work on batch and streaming frames alike.
Dirty casts always go through ``try_cast`` (ANSI mode stays on).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which isspace() is true:
# ASCII \t \n \v \f \r, the separators \x1c-\x1f, \x85 and all Unicode
# separators (Zs, Zl, Zp).  Spark's trim() removes only U+0020.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
_STRIP_RE = rf"^{WS_CLASS}+|{WS_CLASS}+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Unicode-aware strip (same character set as Python's ``str.strip``)."""
    return F.regexp_replace(_c(col), _STRIP_RE, "")


def normalize_label(col) -> Column:
    """N2 lenient normalise: strip + lower; null and '' become null."""
    v = F.lower(py_strip(_c(col)))
    return F.when(v != "", v)


def normalize_label_strict(col) -> Column:
    """N1 strict normalise: like N2 but '', 'neutral', 'nan' and anything
    that is not wholly alphabetic (Unicode letters) become null."""
    v = F.lower(py_strip(_c(col)))
    return F.when(~v.isin("", "neutral", "nan") & v.rlike(r"^\p{L}+$"), v)


def to_num(col) -> Column:
    """N3 numeric coercion: unparsable -> null; 'nan' -> null (not NaN)."""
    d = _c(col).try_cast("double")
    return F.when(~F.isnan(d), d)


def trunc_int(col) -> Column:
    """N10 truncating int cast of a (possibly dirty) intensity."""
    return to_num(col).cast("int")


# Sentiment code map (fixed values of the label scheme).
SENTIMENT_CODES = {"neg": 0, "negative": 0, "0": 0,
                   "neu": 1, "neutral": 1, "1": 1,
                   "pos": 2, "positive": 2, "2": 2}
SENTIMENT_NAMES = ["negative", "neutral", "positive"]


def finite(col) -> Column:
    """``to_num`` restricted to finite values (Python ``int(float(v))``
    raises on infinities, so the callers fall back to their default)."""
    v = to_num(col)
    return F.when(F.abs(v) != F.lit(float("inf")), v)


def py_int(col) -> Column:
    """``int(float(v))`` for a finite double, clamped to a safe int range
    (null stays null: Spark's least/greatest skip nulls)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-1e9)), F.lit(1e9)).cast("int"))


def sentiment_code(col) -> Column:
    """Known spellings map to 0/1/2; else int(float(v)) clamped to 0..2;
    else 1 (null included)."""
    key = F.lower(py_strip(_c(col).cast("string")))
    mapped = F.when(key.isin("neg", "negative", "0"), F.lit(0)) \
        .when(key.isin("neu", "neutral", "1"), F.lit(1)) \
        .when(key.isin("pos", "positive", "2"), F.lit(2))
    num = py_int(finite(key))
    clamped = F.when(num.isNotNull(), F.least(F.greatest(num, F.lit(0)), F.lit(2)))
    return F.coalesce(mapped, clamped, F.lit(1)).cast("int")


TRUE_WORDS = ["1", "1.0", "true", "t", "yes", "y"]


def to_flag(col, name: str, numeric: bool = False) -> Column:
    """N5 presence flag.  Null -> 0.  A numeric column: int(v) != 0.  A string
    column: 1 when the stripped, lower-cased value is in the true-word list or
    equals the emotion name, else 0 (so the string '2' is 0, as in the
    reference where a mixed column is read as strings)."""
    c = _c(col)
    if numeric:
        return F.when(c.isNull(), 0).when(py_int(c.cast("double")) != 0, 1).otherwise(0).cast("int")
    s = F.lower(py_strip(c.cast("string")))
    return (F.when(c.isNull(), 0)
            .when(s.isin(*TRUE_WORDS) | (s == F.lit(name.lower())), 1)
            .otherwise(0)).cast("int")


def intensity_class(col) -> Column:
    """N6 intensity 1..3 -> class 0..2: null/bad -> 0; trunc; <1 -> 0;
    >3 -> 2; else v-1."""
    v = py_int(finite(_c(col).cast("string")))
    return F.coalesce(
        F.when(v < 1, 0).when(v > 3, 2).otherwise(v - 1), F.lit(0)).cast("int")


def word_count(col) -> Column:
    """N11 whitespace-token count (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(_c(col), rf"{WS_CLASS}+"), lambda x: x != ""))


def canonical_text(df, candidates=("Utterances", "utterance", "conversation")) -> Column:
    """First non-empty of the known text spellings, else ''."""
    present = [F.when(F.col(c) != "", F.col(c)) for c in candidates if c in df.columns]
    return F.coalesce(*present, F.lit("")) if present else F.lit("")


def repair_text(df, text: str, original: str = "original", min_len: int = 5):
    """Strip the text; when shorter than ``min_len`` fall back to the
    stripped ``original`` if that is long enough; otherwise drop the row."""
    t = py_strip(F.coalesce(F.col(text).cast("string"), F.lit("")))
    if original in df.columns:
        o = py_strip(F.coalesce(F.col(original).cast("string"), F.lit("")))
        t = F.when(F.length(t) >= min_len, t).when(F.length(o) >= min_len, o).otherwise(t)
    return df.withColumn(text, t).filter(F.length(F.col(text)) >= min_len)

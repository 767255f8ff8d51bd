"""Text rewriting as column expressions (survey D8, D10-D13).

* D10-D12 clean and gate model completions and validate outputs: chains of
  ``regexp_replace`` / ``filter`` over split lines.
* D13 scores a rewrite against its target length and keywords.
* D8 is the rule-based rewrite: every random choice is a seeded hash draw of
  (seed, row id, step), so a row's rewrite never depends on partitioning or
  retries; insertions are ``array_insert`` folds over the word array.

No Python UDF is involved; everything stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affect.functions.clean import WS_CLASS, py_strip, word_count
from affect.functions.draws import uniform

WS = rf"{WS_CLASS}"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"

# Fixed values of the rewrite and validation rules.
META_SENTENCES = [r"In this rewritten.*?[.!]", r"This rewritten.*?[.!]", r"The rewritten.*?[.!]",
                  r"Note that.*?[.!]", r"Please note.*?[.!]", r"\[.*?\]"]
SKIP_LINE_WORDS = ["rewritten", "maintain", "convey", "blend", "primary feeling",
                   "as you can see", "this version", "note:", "example:"]
EMOTION_MENTIONS = [rf"\(intensity{WS}+{DIGIT}+\)",
                    rf"I am feeling (an? )?(intense |strong )?{WORD}+ \(intensity {DIGIT}+\)",
                    rf"feeling (an? )?(intense |strong )?{WORD}+ \(intensity {DIGIT}+\)"]
LABEL_WORDS = ["anger", "anxiety", "depression", "disgust", "fear", "guilt",
               "jealousy", "nervousness", "pain", "sadness", "shame"]
INVALID_PHRASES = ["intensity", "rewritten", "convey", "blend", "primary emotion", "*rolls eyes*",
                   "*sigh*", "*gag*", "note that", "in this message", "(intensity"]
PUNCT = ".,!?;:"
ENDINGS = ["I don't know what to do.", "It's been really hard.", "I'm struggling with this.",
           "I need some help.", "I'm not sure how to handle this."]
LINKING_VERBS = ["feel", "felt", "feeling", "feels", "am", "was", "been"]
META_WORDS = ["intensity", "emotion", "feeling", "express", "convey"]
FIRST_PERSON = ["i ", " me ", "my ", "myself", "i'm"]
INTENSITY_PROB = {1: 0.2, 2: 0.45, 3: 0.75}
FALLBACK_INTENSIFIERS = ["very", "really", "so"]
FALLBACK_STARTERS = ["i", "it", "this"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a column used in several places of one expression, or inside
    the function of an ``exists`` or ``filter``, is otherwise worked out anew at each place and for each element."""
    return F.transform(F.array(value), body)[0]


def _names_any(low: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of ``words``."""
    return _bound(low, lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: t.contains(w)))


def squeeze(col) -> Column:
    return F.regexp_replace(_c(col), rf"{WS}+", " ")


# ---------------------------------------------------------------- D10
def clean_completion(col) -> Column:
    """Ordered regex passes over a model completion."""
    t = py_strip(_c(col))
    for p in META_SENTENCES:
        t = F.regexp_replace(t, "(?is)" + p, "")
    lines = F.split(t, "\n")
    keep = F.filter(lines, lambda ln: (py_strip(ln) != "") & ~_names_any(F.lower(ln), SKIP_LINE_WORDS))
    t = F.array_join(keep, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\*[^*]+\*", ""), r"\*+", "")
    for p in EMOTION_MENTIONS:
        t = F.regexp_replace(t, "(?i)" + p, "")
    t = F.regexp_replace(py_strip(t), "^[\"']|[\"']$", "")
    t = squeeze(t)
    t = F.regexp_replace(t, rf"{WS}+([.,!?;:])", "$1")
    # one pattern; the oracle, whose dialect has no back-references, takes the signs one by one
    t = F.regexp_replace(t, r"([.,!?;:])\1+", "$1")
    return py_strip(t)


def contains_label_words(col) -> Column:
    return _names_any(F.lower(_c(col)), LABEL_WORDS)


# ---------------------------------------------------------------- D11
def gate_completion(completion, original) -> Column:
    """The cleaned completion, or the original when the raw output has
    < 3 words, the cleaned text names a label word, equals the original
    (case-insensitive) or is empty."""
    orig = _c(original)

    def taken(cleaned: Column) -> Column:
        return (F.when(contains_label_words(cleaned), orig)
                 .when(F.lower(py_strip(cleaned)) == F.lower(py_strip(orig)), orig)
                 .when(cleaned == "", orig)
                 .otherwise(cleaned))

    return _bound(py_strip(F.coalesce(_c(completion), F.lit(""))), lambda raw: F.when(word_count(raw) < 3, orig)
                  .otherwise(_bound(clean_completion(raw), taken)))


# ---------------------------------------------------------------- D12
def is_valid_output(col) -> Column:
    """>= 3 characters after strip, none of the banned phrases, no '*',
    no '(intensity n)'."""
    def valid(t: Column) -> Column:
        return (t.isNotNull() & (F.length(py_strip(t)) >= 3) & ~_names_any(F.lower(t), INVALID_PHRASES) & ~t.contains("*")
                & ~F.lower(t).rlike(rf"\({WS}*intensity{WS}+{DIGIT}+{WS}*\)"))

    return _bound(_c(col), valid)


# ---------------------------------------------------------------- D13
def quality_score(original, transformed, target, keywords=None) -> Column:
    """0.5 when unchanged; else 0.5 - min(0.3, 0.3*|len - target| /
    max(1, target)) + min(0.4, 0.12 * hits of the first 5 keywords), in [0, 1]."""
    o, t = _c(original), _c(transformed)
    tg = F.coalesce(_c(target).cast("double"), F.lit(50.0))
    diff = F.abs(word_count(t) - tg) / F.greatest(F.lit(1.0), tg)
    score = F.lit(0.5) - F.least(F.lit(0.3), diff * 0.3)
    if keywords is not None:
        kw = F.slice(F.coalesce(_c(keywords), F.array().cast("array<string>")), 1, 5)
        hits = _bound(F.lower(t), lambda low: F.size(F.filter(kw, lambda k: low.contains(F.lower(k)))))
        score = score + F.least(F.lit(0.4), hits * 0.12)
    same = F.lower(py_strip(o)) == F.lower(py_strip(t))
    return F.when(same, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


# ---------------------------------------------------------------- D8
def _words(t: Column) -> Column:
    return F.filter(F.split(t, rf"{WS}+"), lambda w: w != "")


def _choice(arr: Column, u: Column) -> Column:
    """Seeded ``random.choice``; null for an empty list."""
    return F.try_element_at(arr, (F.floor(u * F.size(arr)) + 1).cast("int"))


def words_of(col) -> Column:
    """Whitespace tokens (``str.split()``)."""
    return _words(_c(col))


def intensity_prob(mean_intensity) -> Column:
    """Insertion probability by the rounded mean bundle intensity."""
    r = F.bround(_c(mean_intensity), 0).cast("int")
    prob = F.lit(0.4)
    for k, v in sorted(INTENSITY_PROB.items(), reverse=True):
        prob = F.when(r == k, F.lit(v)).otherwise(prob)
    return prob


def step_insert_intensifier(df, words: str, intensifiers: str, prob, row_id, seed: int, out: str):
    """With probability ``prob`` insert a drawn intensifier after the
    first linking verb that is not the last word, else (more than two words)
    at a random position 1..n-1."""
    u = lambda step: uniform(seed, row_id, step)
    w = F.col(words)
    n = F.size(w)
    d = df.withColumn("__hit", F.array_position(
        F.transform(w, lambda x, i: F.lower(x).isin(*LINKING_VERBS) & (i < n - 1)), F.lit(True)))
    d = d.withColumn("__ins", _choice(F.col(intensifiers), u("int_choice")))
    rand_pos = (F.floor(u("int_pos") * (n - 1)) + 1).cast("int")
    d = d.withColumn(out, F.when((F.size(intensifiers) > 0) & (u("int_p") < _c(prob)),
                                 F.when(F.col("__hit") > 0, F.array_insert(w, (F.col("__hit") + 1).cast("int"), F.col("__ins")))
                                  .when(n > 2, F.array_insert(w, rand_pos + 1, F.col("__ins"))).otherwise(w))
                     .otherwise(w))
    return d.drop("__hit", "__ins")


def step_insert_keywords(df, words: str, keywords: str, row_id, seed: int, out: str):
    """Insert min(max(1, n//12), 2) drawn keywords that the text does not
    contain yet, each at a random position."""
    d = df.withColumn("__avail", _bound(F.lower(F.array_join(words, " ")), lambda t: F.filter(keywords, lambda k: ~t.contains(F.lower(k)))))
    d = d.withColumn("__ranked", F.array_sort(F.transform("__avail", lambda k: F.struct(
        uniform(seed, F.concat_ws(":", _c(row_id).cast("string"), k), "kw_pick").alias("d"), k.alias("k")))))
    m = F.least(F.greatest(F.lit(1), (F.size(words) / 12).cast("int")), F.lit(2))
    d = d.withColumn("__chosen", F.transform(F.slice("__ranked", 1, F.least(F.size("__ranked"), m)), lambda s, j: F.struct(
        s["k"].alias("k"), uniform(seed, F.concat_ws(":", _c(row_id).cast("string"), j.cast("string")), "kw_pos").alias("u"))))
    d = d.withColumn(out, F.when(F.size(keywords) > 0, F.aggregate("__chosen", F.col(words), lambda acc, s: F.array_insert(
        acc, (F.floor(s["u"] * (F.size(acc) + 1)) + 1).cast("int"), s["k"]))).otherwise(F.col(words)))
    return d.drop("__avail", "__ranked", "__chosen")


def step_replace_starter(df, words: str, starters: str, row_id, seed: int, out: str):
    """With p = .25 replace the first word by a drawn starter (not '*',
    '[' or ']'), capitalised, when it is alphanumeric."""
    u = lambda step: uniform(seed, row_id, step)
    d = df.withColumn("__stc", _choice(F.filter(starters, lambda x: ~x.isin("*", "[", "]")), u("start_choice")))
    w = F.col(words)
    return d.withColumn(out, F.when((F.size(starters) > 0) & (u("start_p") < 0.25) & (F.size(w) > 0)
                                    & F.coalesce(F.col("__stc").rlike(r"^[\p{L}\p{N}]+$"), F.lit(False)),
                                    F.concat(F.array(F.initcap("__stc")), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))))
                        .otherwise(w)).drop("__stc")


def step_fit_length(df, words: str, avg_length, row_id, seed: int, out: str):
    """D8d: below 60 % of the target length append a drawn ending; above
    160 % keep the first 120 %.  Returns text."""
    u = lambda step: uniform(seed, row_id, step)
    d = df.withColumn("__tl", F.coalesce(_c(avg_length), F.lit(50.0)).cast("int"))
    w = F.col(words)
    n = F.size(w)
    ending = _choice(F.array(*[F.lit(e) for e in ENDINGS]), u("ending"))
    d = d.withColumn(out, F.when(n < F.col("__tl") * 0.6, F.concat(F.array_join(w, " "), F.lit(" "), ending))
                     .when(n > F.col("__tl") * 1.6,
                           F.array_join(F.slice(w, 1, F.greatest((F.col("__tl") * 1.2).cast("int"), F.lit(0))), " "))
                     .otherwise(F.array_join(w, " ")))
    return d.drop("__tl")


def step_first_person(df, text: str, row_id, seed: int, out: str):
    """D8e: with p = .3, when no first-person marker occurs, prefix "I "
    (lower-casing an initial capital)."""
    t = F.col(text)
    low = F.lower(t)
    fp = _names_any(low, FIRST_PERSON)
    d = df.withColumn("__f", F.substring(t, 1, 1))
    upper_first = (F.col("__f") != "") & (F.col("__f") == F.upper("__f")) & (F.col("__f") != F.lower("__f"))
    prefixed = F.when(upper_first, F.concat(F.lit("I "), F.lower("__f"), F.substring(t, 2, 1 << 30))) \
        .otherwise(F.concat(F.lit("I "), t))
    return d.withColumn(out, F.when(~fp & (uniform(seed, row_id, "i_p") < 0.3), prefixed).otherwise(t)).drop("__f")


def cleanup(col) -> Column:
    """D8f: strip asterisks, squeeze whitespace, strip."""
    return py_strip(squeeze(F.regexp_replace(_c(col), r"\*+", "")))


def rewrite_rules(df, text, keywords, starters, intensifiers, avg_length, mean_intensity,
                  row_id, seed: int = 42, out: str = "rewritten"):
    """Rule-based rewrite D8g -> D8a -> D8b -> D8c -> D8d -> D8e -> D8f
    with seeded draws per (row, step).  Every step is materialised as a
    column so later steps reference earlier ones by name (no exponential
    expression trees).  Adds ``out``; helper columns are dropped."""
    empty = F.array().cast("array<string>")
    d = df.withColumn("__kw", F.coalesce(_c(keywords), empty)) \
          .withColumn("__st", F.coalesce(_c(starters), empty)) \
          .withColumn("__in", F.coalesce(_c(intensifiers), empty))
    d = d.withColumn("__nothing", (F.size("__kw") == 0) & (F.size("__st") == 0) & (F.size("__in") == 0))
    nothing = F.col("__nothing")
    d = d.withColumn("__in", F.when(nothing, F.array(*[F.lit(w) for w in FALLBACK_INTENSIFIERS])).otherwise(F.col("__in"))) \
         .withColumn("__st", F.when(nothing, F.array(*[F.lit(w) for w in FALLBACK_STARTERS])).otherwise(F.col("__st"))) \
         .withColumn("__kw", F.filter("__kw", lambda k: ~F.lower(k).isin(*META_WORDS)))    # D8g + meta words
    d = d.withColumn("__w0", words_of(text)).withColumn("__p", intensity_prob(mean_intensity))
    d = step_insert_intensifier(d, "__w0", "__in", F.col("__p"), row_id, seed, "__w1")
    d = step_insert_keywords(d, "__w1", "__kw", row_id, seed, "__w2")
    d = step_replace_starter(d, "__w2", "__st", row_id, seed, "__w3")
    d = step_fit_length(d, "__w3", avg_length, row_id, seed, "__t4")
    d = step_first_person(d, "__t4", row_id, seed, "__t5")
    d = d.withColumn(out, cleanup("__t5"))
    return d.drop(*[c for c in d.columns if c.startswith("__") and c not in df.columns])

"""Grouped text statistics (survey T1-T11): style groups, sentence
starters, pronoun rates, per-group TF-IDF keywords, intensifiers, example
retrieval and the pattern report.

TF-IDF is computed per group and without any dense matrix: term frequencies
inside the row -> document frequencies per (group, term) (partial aggregation
before the shuffle) -> vocabulary cut (min_df, top max_features by corpus
frequency) -> smooth idf as a map per group -> L2 norm inside the row -> mean over the
group's documents -> top-n.  Ranking windows only ever see aggregated (group,
term) rows, never raw tokens, so a dominant label does not put raw data into one task.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affect.functions.clean import WS_CLASS, to_num, word_count
from affect.operators.labels import SLOTS, explode_slots, sentiment_label
from affect.operators.sampling import draw_long, lowest_by_draw
from affect.session import materialize

_HERE = os.path.dirname(os.path.abspath(__file__))


def english_stop_words() -> list[str]:
    """Spark ML's default English stop-word list (StopWordsRemover), kept as a
    resource so that the Spark job and the oracle use the same words."""
    path = os.path.join(os.path.dirname(_HERE), "functions", "stopwords_en.txt")
    with open(path, encoding="utf-8") as f:
        return [w.strip() for w in f if w.strip()]


# Intensifier word lists of the style miner (emotion level,
# then emotion x intensity level; the second list's duplicate is removed).
INTENSIFIERS = ["very", "really", "so", "extremely", "absolutely", "completely",
                "totally", "deeply", "highly", "incredibly", "particularly",
                "especially", "quite", "rather", "fairly", "pretty", "somewhat",
                "constantly", "always", "never", "forever", "endlessly",
                "utterly", "purely", "entirely", "wholly", "fully"]
INTENSITY_INTENSIFIERS = ["very", "really", "so", "extremely", "absolutely", "completely",
                          "totally", "deeply", "highly", "incredibly", "particularly",
                          "especially", "quite", "rather", "fairly", "pretty", "somewhat",
                          "constantly", "always", "never", "forever", "endlessly",
                          "utterly", "purely", "entirely", "wholly", "fully",
                          "barely", "slightly", "moderately", "considerably"]
PRONOUNS = ["i", "me", "my", "myself", "we", "us", "our"]

WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"      # = \b\w\w+\b (runs of >= 2 word chars)
WORD_RUN = r"[\p{L}\p{N}_]+"
ASCII_WORD = r"^[a-zA-Z]+$"             # = \b[a-zA-Z]+\b on a word run


# ---------------------------------------------------------------- tokenisers
def word_tokens(text: Column) -> Column:
    """Lower-cased tokens of >= 2 word characters (TF-IDF default pattern)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), 0)


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters made of ASCII letters only."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), 0)
    return F.filter(runs, lambda t: t.rlike(ASCII_WORD))


def with_terms(df: DataFrame, tokens: Column, stop_words: list[str] | None, ngram_max: int = 1,
               out: str = "terms") -> DataFrame:
    """Adds ``out``: tokens without stop words, then their 1..ngram_max grams
    joined by a space.  The filtered token array is materialised as a column
    first, so the n-gram lambda reads it instead of re-tokenising per
    element."""
    toks = tokens
    if stop_words:
        # IN-list over > 10 literals is planned as a hash-set lookup (InSet)
        toks = F.filter(tokens, lambda t: ~t.isin(*stop_words))
    d = df.withColumn("__tok", toks)
    t = F.col("__tok")
    res = t
    for n in range(2, ngram_max + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                            lambda i: F.array_join(F.slice(t, i, n), " "))
        res = F.concat(res, F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>")))
    return d.withColumn(out, res).drop("__tok")


# ---------------------------------------------------------------- T6 core
def term_counts(terms: str | Column) -> Column:
    """(term, tf) of every distinct term of an array, from runs of the sorted array: linear after the sort, so that
    long texts cost no more for each term."""
    t = F.col(terms) if isinstance(terms, str) else terms

    def runs(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(s, i) != F.element_at(s, F.least(i + 1, n))))
        return _let(ends, lambda e: F.transform(e, lambda last, j: F.struct(
            F.element_at(s, last).alias("term"), (last - F.when(j > 0, F.element_at(e, F.greatest(j, F.lit(1)))).otherwise(0)).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term: string, tf: bigint>>")
    return F.when(F.size(t) > 0, _let(F.array_sort(t), runs)).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tfidf_scores(docs: DataFrame, keys: list[str], term_col: str = "terms",
                 min_df: int = 2, max_features: int | None = 50) -> DataFrame:
    """Mean L2-normalised TF-IDF score per (keys, term) over the group's
    documents.  ``docs`` holds one row per document with an array of terms.
    Returns (keys, term, score).

    Term frequencies are counted, and vectors normalised, inside the row: only
    (key, term) sums are shuffled, never a document's terms.  The counted documents are
    written once (they serve the vocabulary and the scores).  ``max_features`` terms of the
    greatest corpus frequency a key make its vocabulary, looked up as a map; without
    a limit the vocabulary is joined by (key, term) instead."""
    counted = materialize(docs.select(*keys, term_counts(term_col).alias("__tf")), "term_counts")
    # one more entry a document, of no term, counts the documents
    one = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
    sums = (counted.select(*keys, F.inline(F.concat(one, "__tf"))).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf")))
    sums = materialize(sums, "terms")
    n_docs = sums.where("term is null").select(*keys, F.col("df").alias("__n"))
    vocab = sums.where((F.col("df") >= min_df) & F.col("term").isNotNull())
    if max_features:
        w = Window.partitionBy(*keys).orderBy(F.desc("ctf"), "term")
        vocab = vocab.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_features)
    idf = F.log((F.lit(1.0) + F.col("__n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    vocab = vocab.join(n_docs, on=keys).select(*keys, "term", idf.alias("idf"), "__n")
    if max_features:
        maps = vocab.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("__idf"), F.first("__n").alias("__n"))
        weighed = F.filter(F.transform("__tf", lambda x: F.struct(x["term"].alias("term"), (x["tf"] * F.try_element_at("__idf", x["term"])).alias("v"))), lambda x: x["v"].isNotNull())
        x = counted.join(maps, on=keys).select(*keys, "__n", weighed.alias("__v"))
        norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, y: a + y["v"] * y["v"]))
        x = x.withColumn("__norm", norm).select(*keys, "__n", "__norm", F.inline("__v")).withColumn("__nv", F.col("v") / F.col("__norm"))
    else:
        rows = counted.withColumn("__doc", F.monotonically_increasing_id()).select(*keys, "__doc", F.inline("__tf"))
        x = rows.join(vocab, on=[*keys, "term"]).withColumn("v", F.col("tf") * F.col("idf"))
        x = x.withColumn("__nv", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("__doc"))))
    # rounded to 12 dp so that mathematically tied terms tie exactly whatever
    # the summation order, and the term order decides
    return x.groupBy(*keys, "term").agg(F.round(F.sum("__nv") / F.first("__n"), 12).alias("score"))


def ranked_terms(scores: DataFrame, keys: list[str], top_n: int, restrict: list[str] | None = None) -> DataFrame:
    """(keys, term, score, __r): the best ``top_n`` terms per group, score desc, term asc."""
    s = scores.where(F.col("term").isin(*dict.fromkeys(restrict))) if restrict is not None else scores
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "term")
    return s.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top_n)


def top_terms(scores: DataFrame, keys: list[str], top_n: int, ascending_output: bool = True,
              restrict: list[str] | None = None) -> DataFrame:
    """Best ``top_n`` terms per group (score desc, term asc), returned as an
    ordered array ``keywords`` (ascending score when ``ascending_output``, as
    the reference returns its ``argsort`` tail)."""
    r = ranked_terms(scores, keys, top_n, restrict)
    g = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "term"))).alias("__l"))
    lst = F.transform(F.col("__l"), lambda x: x["term"])
    return g.select(*keys, (F.reverse(lst) if ascending_output else lst).alias("keywords"))


# ---------------------------------------------------------------- T1 records
def style_records(df: DataFrame, text_col: str = "utterance", id_col: str = "utt_id",
                  keep_null_sentiment: bool = False) -> DataFrame:
    """L2 records with the canonical text and sentiment: (id, slot, emotion,
    intensity, sentiment, text)."""
    base = df.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("nan")).alias("text"),
                     sentiment_label("sentiment", keep_null_sentiment).alias("sentiment"),
                     *[c for pair in SLOTS for c in pair])
    r = explode_slots(base, keep=[id_col, "text", "sentiment"])
    return r.where(F.col("sentiment").isNotNull()) if not keep_null_sentiment else r


def style_groups(records: DataFrame, min_size: int = 5) -> DataFrame:
    """Groups (emotion, float intensity, sentiment) with >= min_size
    records; the style key uses int(intensity) and on a collision the group
    with the larger float intensity wins.  Returns (emotion, intensity_key,
    sentiment, intensity) for the kept groups."""
    g = records.groupBy("emotion", "intensity", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    g = g.where(F.col("n") >= min_size).withColumn("intensity_key", F.col("intensity").cast("int"))
    w = Window.partitionBy("emotion", "intensity_key", "sentiment").orderBy(F.desc("intensity"))
    return (g.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
             .select("emotion", "intensity_key", "sentiment", "intensity"))


GROUP_KEY = ["emotion", "intensity_key", "sentiment"]


def group_docs(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Records of the kept style groups (one document per record)."""
    return records.join(groups, on=["emotion", "intensity", "sentiment"], how="inner")


# ---------------------------------------------------------------- T2-T5
def sentence_starters(docs: DataFrame, keys=GROUP_KEY, k: int = 15, id_col: str = "utt_id") -> DataFrame:
    """First word (lower-cased) of every sentence (split on [.!?]+,
    stripped, non-empty); top k by count, ties by first appearance."""
    sents = docs.select(*keys, id_col, "slot", F.posexplode(F.split("text", r"[.!?]+")).alias("spos", "s"))
    first = F.lower(F.element_at(F.split(F.regexp_replace("s", rf"^{WS_CLASS}+", ""), rf"{WS_CLASS}+"), 1))
    st = sents.select(*keys, F.struct(id_col, "slot", "spos").alias("__seen"), first.alias("starter"))
    st = st.where(F.col("starter").isNotNull() & (F.col("starter") != ""))
    c = st.groupBy(*keys, "starter").agg(F.count(F.lit(1)).alias("cnt"), F.min("__seen").alias("__seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "__seen")
    r = c.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    g = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "starter"))).alias("__l"))
    return g.select(*keys, F.transform("__l", lambda x: x["starter"]).alias("sentence_starters"))


def _count_sub(t: Column, pat: str) -> Column:
    """Non-overlapping occurrences of a literal (``str.count``)."""
    return ((F.length(t) - F.length(F.replace(t, F.lit(pat), F.lit("")))) / F.lit(len(pat))).cast("int")


def style_profile(docs: DataFrame, keys=GROUP_KEY) -> DataFrame:
    """Sample count, average words, pronoun frequencies,
    question and exclamation ratios per group (one aggregation)."""
    low = F.lower(F.col("text"))
    aggs = [F.count(F.lit(1)).alias("sample_count"), F.avg(word_count(F.col("text"))).alias("avg_length"),
            F.avg(F.when(F.col("text").contains("?"), 1.0).otherwise(0.0)).alias("question_ratio"),
            F.avg(F.when(F.col("text").contains("!"), 1.0).otherwise(0.0)).alias("exclamation_ratio")]
    aggs += [F.avg(_count_sub(low, f" {p} ") + _count_sub(low, f"{p} ")).alias(f"pronoun_{p}") for p in PRONOUNS]
    g = docs.groupBy(*keys).agg(*aggs)
    return g.withColumn("pronoun_freq", F.map_from_arrays(
        F.array(*[F.lit(p) for p in PRONOUNS]), F.array(*[F.col(f"pronoun_{p}") for p in PRONOUNS]))) \
        .drop(*[f"pronoun_{p}" for p in PRONOUNS])


# ---------------------------------------------------------------- T6
def tfidf_keywords(docs: DataFrame, keys=GROUP_KEY, top_n: int = 20, ngram_max: int = 2, min_df: int = 2,
                   max_features: int | None = 50, stop_words: list[str] | None = None) -> DataFrame:
    """Per-group TF-IDF keywords (see module doc); groups whose
    vocabulary is empty get no row (callers coalesce to [])."""
    sw = english_stop_words() if stop_words is None else stop_words
    d = with_terms(docs.select(*keys, "text"), word_tokens(F.col("text")), sw, ngram_max).drop("text")
    sc = tfidf_scores(d, list(keys), min_df=min_df, max_features=max_features)
    return top_terms(sc, list(keys), top_n)


# ---------------------------------------------------------------- T7 / T8
def _slot_docs(df: DataFrame, text_col: str, with_intensity: bool, keep_null_label: bool) -> DataFrame:
    """(slot, emotion, [intensity,] terms): one row for each slot with a label; the text is read and cut into terms once a row."""
    slots = []
    for k, (e, i) in enumerate(SLOTS):
        label = F.lower(F.regexp_replace(F.col(e).cast("string"), rf"^{WS_CLASS}+|{WS_CLASS}+$", ""))
        slots.append(F.struct(F.lit(k + 1).alias("slot"), (F.coalesce(label, F.lit("nan")) if keep_null_label else label).alias("emotion"),
                              *([to_num(i).alias("intensity")] if with_intensity else [])))
    terms = ascii_tokens(F.coalesce(F.col(text_col).cast("string"), F.lit("nan")))
    out = df.select(terms.alias("terms"), F.array(*slots).alias("__s")).select("terms", F.inline("__s")).where("emotion is not null and emotion <> ''")
    return out.where(F.col("intensity").isNotNull()) if with_intensity else out


def intensifiers(df: DataFrame, by_intensity: bool = False, top_n: int = 10, min_rows: int = 10,
                 text_col: str = "utterance", keep_null_label: bool = False, max_features: int | None = 100) -> DataFrame:
    """T7 (``by_intensity=False``): per emotion, computed per slot (groups of
    >= min_rows rows, unigram TF-IDF over ASCII words, df >= 2, top ``max_features``),
    restricted to the intensifier list, best ``top_n`` by score; the slots of an
    emotion are merged by each word's best score, and the best ``top_n`` stay.

    T8 (``by_intensity=True``): the same per (emotion, float intensity) with
    the longer list; the key is (emotion, int(intensity)) and a later slot
    (then a larger float intensity) overwrites an earlier one.
    """
    words = INTENSITY_INTENSIFIERS if by_intensity else INTENSIFIERS
    gkeys = ["slot", "emotion"] + (["intensity"] if by_intensity else [])
    docs = _slot_docs(df, text_col, by_intensity, keep_null_label)
    sizes = docs.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") >= min_rows)
    sc = tfidf_scores(docs.join(sizes.drop("__rows"), on=gkeys, how="left_semi"), gkeys, min_df=2, max_features=max_features)
    if by_intensity:
        top = top_terms(sc, gkeys, top_n, ascending_output=False, restrict=words).withColumn("intensity_key", F.col("intensity").cast("int"))
        w = Window.partitionBy("emotion", "intensity_key").orderBy(F.desc("slot"), F.desc("intensity"))
        return (top.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
                   .select("emotion", F.col("intensity_key").alias("intensity"), "keywords")
                   .withColumnRenamed("keywords", "intensifiers"))
    best = ranked_terms(sc, gkeys, top_n, words).groupBy("emotion", "term").agg(F.max("score").alias("score"))
    return top_terms(best, ["emotion"], top_n, ascending_output=False).withColumnRenamed("keywords", "intensifiers")


# ---------------------------------------------------------------- T9
def examples(df: DataFrame, keys: DataFrame, k: int = 3, seed: int = 7,
             text_col: str = "utterance", id_col: str = "utt_id") -> DataFrame:
    """Up to ``k`` texts per requested (emotion, intensity, sentiment)
    whose any slot matches (a row matching in two slots counts twice), chosen
    by seeded hash draw (skew-safe exact selection, no group sort).
    Returns (emotion, intensity, sentiment, slot, id, text)."""
    recs = explode_slots(df.select(id_col, F.col(text_col).alias("text"),
                                   sentiment_label("sentiment").alias("sentiment"),
                                   *[c for p in SLOTS for c in p]), keep=[id_col, "text", "sentiment"])
    recs = recs.join(keys.select("emotion", "intensity", "sentiment"),
                     on=["emotion", "intensity", "sentiment"], how="left_semi")
    quota = keys.select("emotion", "intensity", "sentiment", F.lit(k).cast("long").alias("__quota"))
    rid = F.concat_ws("#", F.col(id_col).cast("string"), F.col("slot").cast("string"))
    recs = recs.withColumn("__rid", rid)
    pick = lowest_by_draw(recs, ["emotion", "intensity", "sentiment"], quota,
                          draw_long(seed, "__rid", "example"), tie="__rid")
    return pick.select("emotion", "intensity", "sentiment", "slot", id_col, "text", "__rank_draw")


# ---------------------------------------------------------------- T10 / T11
def style_patterns(df: DataFrame, text_col: str = "utterance", id_col: str = "utt_id",
                   min_size: int = 5, stop_words: list[str] | None = None) -> DataFrame:
    """T1-T6 assembled: one row per style key with sample_count, avg_length,
    sentence_starters, pronoun_freq, ratios and keywords ([] when empty)."""
    recs = style_records(df, text_col, id_col)
    groups = style_groups(recs, min_size)
    docs = materialize(group_docs(recs, groups), "style_docs")  # read by the profile, the starters and the keywords
    prof = style_profile(docs)
    st = sentence_starters(docs, id_col=id_col)
    kw = tfidf_keywords(docs, stop_words=stop_words)
    return (prof.join(st, on=GROUP_KEY, how="left").join(kw, on=GROUP_KEY, how="left")
                .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
                .withColumn("sentence_starters", F.coalesce("sentence_starters", F.array().cast("array<string>")))
                .withColumnRenamed("intensity_key", "intensity"))


def pattern_report(patterns: DataFrame) -> DataFrame:
    """Per key count, avg_length (2 dp), number of keywords, first 5
    keywords, first 3 starters, question/exclamation ratios (3 dp), sorted."""
    return (patterns.select(
        "emotion", "intensity", "sentiment", "sample_count",
        F.bround("avg_length", 2).alias("avg_length"), F.size("keywords").alias("num_keywords"),
        F.array_join(F.slice("keywords", 1, 5), ", ").alias("top_5_keywords"),
        F.array_join(F.slice("sentence_starters", 1, 3), ", ").alias("top_3_starters"),
        F.bround("question_ratio", 3).alias("question_ratio"),
        F.bround("exclamation_ratio", 3).alias("exclamation_ratio"))
        .orderBy("emotion", "intensity", "sentiment"))


def pattern_diagnostics(patterns: DataFrame, emotion_int: DataFrame, intensity_int: DataFrame) -> DataFrame:
    """Totals — patterns, patterns without keywords, emotion-only and
    intensity-aware intensifier keys."""
    a = patterns.agg(F.count(F.lit(1)).alias("patterns"),
                     F.count_if(F.size("keywords") == 0).alias("patterns_without_keywords"))
    b = emotion_int.agg(F.count(F.lit(1)).alias("emotion_only_keys"))
    c = intensity_int.agg(F.count(F.lit(1)).alias("intensity_aware_keys"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return u.agg(*[F.max(x).alias(x) for x in ("patterns", "patterns_without_keywords",
                                                "emotion_only_keys", "intensity_aware_keys")])

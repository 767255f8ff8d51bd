"""Domain adaptation (survey D1-D6, D9): make a source corpus compatible
with a target corpus and attach the target's style patterns to every source
row.

All lookups are joins against small, bounded tables (label vocabularies,
(emotion, intensity) pair counts, style patterns keyed by label triples),
broadcast explicitly; the source corpus itself is never shuffled by these
steps — each slot of a row is looked up by its own broadcast hash join, so
a row's three slots need no regrouping by row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affect.functions.clean import WS_CLASS, normalize_label, to_num, word_count
from affect.operators.labels import SLOTS, explode_slots, vocabulary
from affect.session import materialize

# What a bundle without mined patterns gets.
DEFAULT_INTENSIFIERS = ["very", "really", "so", "quite", "extremely"]
DEFAULT_STARTERS = ["i", "it", "that", "this", "my", "the"]


# ---------------------------------------------------------------- D1
def target_vocabulary(target: DataFrame) -> DataFrame:
    """Labels the style miner saw in the target: lenient labels of slots
    with a numeric intensity."""
    return (explode_slots(target, keep=[]).select("emotion").distinct())


def compatible_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """(emotion, status) — 'compatible' for labels in both vocabularies,
    'incompatible' for source labels the target lacks."""
    src = vocabulary(source).select("emotion")
    tgt = target_vocabulary(target)
    both = src.intersect(tgt).withColumn("status", F.lit("compatible"))
    only = src.subtract(tgt).withColumn("status", F.lit("incompatible"))
    return both.unionByName(only)


# ---------------------------------------------------------------- D2-D4
def _slot_label(k: int) -> Column:
    return normalize_label(SLOTS[k][0])


def _lookup(df: DataFrame, table: DataFrame, on: list, prefix: str) -> DataFrame:
    """Left lookup in a table with columns renamed by prefix;
    ``on`` lists (left Column, right column name) pairs.  Spark broadcasts the table if it is small."""
    t = table.select(*[F.col(c).alias(f"{prefix}{c}") for c in table.columns])
    cond = None
    for left, right in on:
        c = left == F.col(f"{prefix}{right}")
        cond = c if cond is None else cond & c
    return df.join(t, cond, "left")


def label_flags(df: DataFrame, compatible: DataFrame) -> DataFrame:
    """``keep_label`` = some slot label is in the compatible set (three
    lookups, one per slot)."""
    comp = compatible.where(F.col("status") == "compatible").select("emotion").distinct()
    out = df
    for k in range(3):
        out = _lookup(out, comp, [(_slot_label(k), "emotion")], f"__c{k}_")
    hit = F.lit(False)
    for k in range(3):
        hit = hit | F.col(f"__c{k}_emotion").isNotNull()
    return out.withColumn("keep_label", hit).drop(*[f"__c{k}_emotion" for k in range(3)])


def intensity_ok(allowed=(1.0, 2.0, 3.0)) -> Column:
    """D3: every non-null intensity parses and is one of ``allowed``."""
    ok = F.lit(True)
    for _, i in SLOTS:
        v = F.col(i).cast("string").try_cast("double")
        ok = ok & (F.col(i).isNull() | F.coalesce(v.isin(*[float(a) for a in allowed]), F.lit(False)))
    return ok


def _pair(k: int):
    e, i = SLOTS[k]
    raw = F.col(e)
    valid = raw.isNotNull() & (raw.cast("string") != "") & to_num(i).isNotNull()
    return valid, F.lower(F.regexp_replace(raw.cast("string"), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")), to_num(i)


def pair_counts(df: DataFrame) -> DataFrame:
    """(emotion, intensity, cnt) over the slots with a label and a numeric
    intensity (bounded by labels x intensity values)."""
    arr = F.array(*[F.when(v, F.struct(e.alias("emotion"), x.alias("intensity")))
                    for v, e, x in (_pair(k) for k in range(3))])
    return (df.select(F.explode(F.filter(arr, lambda s: s.isNotNull())).alias("p"))
              .groupBy("p.emotion", "p.intensity").agg(F.count(F.lit(1)).alias("cnt")))


def rare_flags(df: DataFrame, min_samples: int = 10, scope: Column | None = None) -> DataFrame:
    """When some (emotion, intensity) pair is rarer than ``min_samples``
    keep rows having at least one non-rare valid pair; when none is rare the
    step keeps every row.  Pair counts are taken over the rows satisfying
    ``scope`` (the survivors of D2 and D3); rows outside it get null."""
    counts = materialize(pair_counts(df if scope is None else df.where(scope)), "pair_counts")
    n_rare = counts.agg(F.count_if(F.col("cnt") < min_samples)).scalar()
    out = df
    for k in range(3):
        v, e, x = _pair(k)
        out = _lookup(out, counts, [(e, "emotion"), (x, "intensity")], f"__p{k}_")
        out = out.withColumn(f"__ok{k}", v & (F.col(f"__p{k}_cnt") >= min_samples))
    keep = (F.coalesce(n_rare, F.lit(0)) == 0) | F.col("__ok0") | F.col("__ok1") | F.col("__ok2")
    drop = [c for c in out.columns if c.startswith("__p") or c.startswith("__ok")]
    flag = F.coalesce(keep, F.lit(False))
    if scope is not None:
        flag = F.when(scope, flag)
    return out.withColumn("keep_rare", flag).drop(*drop)


def filter_for_target(source: DataFrame, target: DataFrame, min_samples: int = 10,
                      allowed=(1.0, 2.0, 3.0), remove_incompatible: bool = True) -> tuple[DataFrame, DataFrame]:
    """D2-D4 in sequence; returns (flagged source, compatibility table).
    The flagged frame carries keep_label / keep_intensity / keep_rare and the
    filtered corpus is ``where(keep_label & keep_intensity & keep_rare)``."""
    # the label table is tiny and used twice (flags, report): written once
    comp = materialize(compatible_labels(source, target), "compatible_labels")
    f = label_flags(source, comp) if remove_incompatible else source.withColumn("keep_label", F.lit(True))
    f = f.withColumn("keep_intensity", intensity_ok(allowed))
    # one pass for the pair counts over the survivors, one pass for the flags
    return rare_flags(f, min_samples, scope=F.col("keep_label") & F.col("keep_intensity")), comp


def filtered(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("keep_label") & F.col("keep_intensity") & F.coalesce(F.col("keep_rare"), F.lit(False))) \
                  .drop("keep_label", "keep_intensity", "keep_rare")


# ---------------------------------------------------------------- D5
def filter_report(flagged: DataFrame, comp: DataFrame) -> DataFrame:
    """Sizes, rows removed by each step, label lists and removed %."""
    kl, ki, kr = F.col("keep_label"), F.col("keep_intensity"), F.coalesce(F.col("keep_rare"), F.lit(False))
    a = flagged.agg(F.count(F.lit(1)).alias("original_size"),
                    F.count_if(kl & ki & kr).alias("filtered_size"),
                    F.count_if(~kl).alias("removed_by_emotion"),
                    F.count_if(kl & ~ki).alias("removed_by_intensity"),
                    F.count_if(kl & ki & ~kr).alias("removed_by_rarity"))
    labels = comp.agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "compatible", F.col("emotion")))), ",")
        .alias("compatible_emotions"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "incompatible", F.col("emotion")))), ",")
        .alias("incompatible_emotions"))
    u = a.unionByName(labels, allowMissingColumns=True)
    one = u.agg(*[F.max(c).alias(c) for c in a.columns + labels.columns])
    return (one.withColumn("removed_total", F.col("original_size") - F.col("filtered_size"))
               .withColumn("removed_pct", F.col("removed_total") / F.col("original_size") * 100))


# ---------------------------------------------------------------- D6
def bundle_columns(src: DataFrame, sentiment_default: str = "negative") -> DataFrame:
    """``src`` with its bundle as looked up in pattern tables: ``__slots`` (e, i of the slots that have both; an empty bundle
    is (neutral, 2)), ``__sent`` and ``__bk``, a key of the two."""
    slots = F.array(*[F.when(normalize_label(e).isNotNull() & to_num(i).isNotNull(),
                             F.struct(F.lit(k).alias("slot"), normalize_label(e).alias("e"), to_num(i).cast("int").alias("i"))) for k, (e, i) in enumerate(SLOTS)])
    neutral = F.array(F.struct(F.lit(0).alias("slot"), F.lit("neutral").alias("e"), F.lit(2).alias("i")))
    d = src.withColumn("__slots", F.filter(slots, lambda x: x.isNotNull())).withColumn("__sent", F.coalesce(F.lower(F.col("sentiment").cast("string")), F.lit(sentiment_default)))
    d = d.withColumn("__slots", F.when(F.size("__slots") > 0, F.col("__slots")).otherwise(neutral))
    return d.withColumn("__bk", F.to_json(F.struct("__sent", "__slots")))


def _best_first(els: Column, of) -> Column:
    """Terms of all elements, ranked by their best place in any element's list (``of``: element -> array of (place, term)), ties by term."""
    return _terms(F.flatten(F.transform(els, of)))


def _terms(ranked: Column) -> Column:
    return F.array_distinct(F.transform(F.array_sort(ranked), lambda x: x["t"]))


def _placed(terms: Column, best_last: bool = False) -> Column:
    """(place, term) from 0, the best first."""
    t = F.coalesce(terms, F.array().cast("array<string>"))
    return F.transform(t, lambda x, j: F.struct((F.size(t) - 1 - j if best_last else j).cast("int").alias("r"), x.alias("t")))


def composed_patterns(bundles: DataFrame, patterns: DataFrame, emotion_int: DataFrame, intensity_int: DataFrame, examples: DataFrame) -> DataFrame:
    """One row for each distinct bundle and sentiment (``__bk``): its merged patterns.

    ``patterns`` (emotion, intensity, sentiment, keywords, sentence_starters,
    avg_length), ``emotion_int`` (emotion, intensifiers), ``intensity_int``
    (emotion, intensity, intensifiers) and ``examples`` (emotion, intensity,
    sentiment, texts) are joined to the bundles' elements, and an element's
    lists merged: keywords (<= 30), starters (<= 15, default list when empty) and intensifiers (by
    fallback pair -> emotion -> default list, <= 15) ranked by their best
    mined place in any element, mean avg_length of the matched keys (else mean words of the
    examples, else 50), examples (<= 6), keyword fallback = 20 commonest example
    words (ties by first appearance)."""
    el = bundles.select("__bk", "__sent", F.inline("__slots"))
    pt = patterns.select(F.col("emotion").alias("e"), F.col("intensity").alias("i"), F.col("sentiment").alias("__sent"), F.col("keywords").alias("kw"),
                         F.col("sentence_starters").alias("st"), F.col("avg_length").alias("al"))
    ia = intensity_int.select(F.col("emotion").alias("e"), F.col("intensity").alias("i"), F.col("intensifiers").alias("ia"))
    eo = emotion_int.select(F.col("emotion").alias("e"), F.col("intensifiers").alias("eo"))
    ex = examples.select(F.col("emotion").alias("e"), F.col("intensity").alias("i"), F.col("sentiment").alias("__sent"), F.col("texts").alias("ex"))
    el = el.join(pt, ["e", "i", "__sent"], "left").join(ia, ["e", "i"], "left").join(eo, "e", "left").join(ex, ["e", "i", "__sent"], "left")
    empty = F.array().cast("array<string>")
    parts = F.struct("slot", "kw", "st", "al", F.coalesce("ia", empty).alias("ia"), F.coalesce("eo", empty).alias("eo"), F.coalesce("ex", empty).alias("ex"))
    d = el.groupBy("__bk").agg(F.array_sort(F.collect_list(parts)).alias("__els"))  # three elements at most
    els = F.col("__els")
    defaults = F.array(*[F.struct(F.lit(j).alias("r"), F.lit(w).alias("t")) for j, w in enumerate(DEFAULT_INTENSIFIERS)])

    def add_intens(acc, x):
        with_emo = F.concat(acc, _placed(x["eo"]))
        return F.when(F.size(x["ia"]) > 0, F.concat(acc, _placed(x["ia"]))).otherwise(F.when(F.size(with_emo) == 0, defaults).otherwise(with_emo))

    none = F.array().cast("array<struct<r: int, t: string>>")
    d = (d.withColumn("__matched", F.filter(els, lambda x: x["al"].isNotNull()))
          .withColumn("__kwu", _best_first(els, lambda x: _placed(x["kw"], best_last=True)))
          .withColumn("__stu", _best_first(els, lambda x: _placed(x["st"])))
          .withColumn("__int", _terms(F.aggregate(els, none, add_intens)))
          .withColumn("__exs", F.flatten(F.transform(els, lambda x: x["ex"]))))
    matched, kw, st, exs = F.col("__matched"), F.col("__kwu"), F.col("__stu"), F.col("__exs")
    d = d.withColumn("__exw", F.flatten(F.transform(
        exs, lambda t: F.filter(F.split(F.lower(t), rf"{WS_CLASS}+"), lambda w: w != ""))))
    avg_al = F.aggregate(matched, F.lit(0.0), lambda a, x: a + x["al"]) / F.size(matched)
    ex_len = F.aggregate(F.transform(exs, lambda t: word_count(t).cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size(exs)
    need_common = (F.size(kw) == 0) & (F.size(exs) > 0)
    # only bundles that match no pattern but have examples pay for the word count
    ranked = F.array_sort(F.transform(F.array_distinct(F.col("__exw")), lambda w, i: F.struct(
        (-F.size(F.filter(F.col("__exw"), lambda x: x == w))).alias("neg"), i.alias("pos"), w.alias("w"))))
    common = F.transform(F.slice(ranked, 1, 20), lambda s: s["w"])
    return d.select(
        "__bk", F.slice(F.when(need_common, common).otherwise(kw), 1, 30).alias("keywords"),
        F.slice(F.when(F.size(st) == 0, F.array(*[F.lit(s) for s in DEFAULT_STARTERS])).otherwise(st), 1, 15).alias("sentence_starters"),
        F.when(F.size(matched) > 0, avg_al).when(F.size(exs) > 0, ex_len).otherwise(F.lit(50.0)).alias("avg_length"),
        F.slice("__int", 1, 15).alias("intensifiers"), F.slice(exs, 1, 6).alias("examples"), exs.alias("prompt_examples"))


def attach_patterns(src: DataFrame, patterns: DataFrame, emotion_int: DataFrame, intensity_int: DataFrame,
                    examples: DataFrame, sentiment_default: str = "negative") -> DataFrame:
    """Every source row with the target patterns of its bundle and sentiment: patterns
    are composed once for each distinct bundle (:func:`composed_patterns`) and joined once."""
    d = bundle_columns(src, sentiment_default)
    bundles = d.select("__bk", "__sent", "__slots").dropDuplicates(["__bk"])
    composed = materialize(composed_patterns(bundles, patterns, emotion_int, intensity_int, examples), "composed")
    taken = [c for c in composed.columns if c != "__bk"]
    return d.drop(*taken, "__slots", "__sent").join(composed, "__bk", "left").drop("__bk")


# ---------------------------------------------------------------- D9
# Cue phrases per (emotion, intensity) used in prompts and the
# emotion words that disqualify an example.
EMOTION_CUES = {
    ("sad", 1): "things feel a bit off, nothing seems worth the effort",
    ("sad", 2): "everything feels heavy, can't stop thinking about what went wrong",
    ("sad", 3): "can barely get out of bed, nothing matters anymore",
    ("angry", 1): "it's bothering me more than it should",
    ("angry", 2): "jaw clenching, wanting to yell at someone",
    ("angry", 3): "shaking with rage, can't think straight",
    ("anxiety", 1): "something feels off, can't quite relax",
    ("anxiety", 2): "heart racing, checking things over and over",
    ("anxiety", 3): "can't breathe properly, everything closing in",
    ("afraid", 1): "uneasy feeling that something bad might happen",
    ("afraid", 2): "looking over shoulder, hands shaking",
    ("afraid", 3): "paralyzed, can't move, wanting to hide",
    ("disgusted", 1): "uncomfortable, wanting to look away",
    ("disgusted", 2): "stomach turning, can't stand this",
    ("disgusted", 3): "physically sick, wanting to get far away",
    ("surprised", 1): "wasn't expecting that at all",
    ("surprised", 2): "can't believe what happened, mind racing",
    ("surprised", 3): "completely stunned, don't know how to react",
    ("joyful", 1): "things are looking up a bit",
    ("joyful", 2): "can't help but smile, everything feels lighter",
    ("joyful", 3): "feeling like floating, wanting to tell everyone",
    ("hopeful", 1): "maybe things could work out after all",
    ("hopeful", 2): "starting to see possibilities, feels like new beginning",
    ("hopeful", 3): "everything falling into place, know it's going to be amazing",
    ("neutral", 1): "it is what it is, going through the motions",
    ("neutral", 2): "don't feel much about it either way",
    ("neutral", 3): "everything just feels flat and empty",
}
EXAMPLE_BLOCK_WORDS = ["sad", "angry", "anxious", "afraid", "disgusted", "surprised",
                       "joyful", "hopeful", "neutral", "happy", "fear", "anger",
                       "sadness", "joy", "disgust", "anxiety", "surprise", "scared",
                       "worried", "frustrated", "depressed", "excited", "nervous"]


def cue_of(emotion: Column, intensity: Column) -> Column:
    """The cue phrase of a label and whole intensity, null if it has none."""
    cues = F.create_map(*[F.lit(v) for (e, i), cue in EMOTION_CUES.items() for v in (f"{e}:{i}", cue)])
    return F.try_element_at(cues, F.concat_ws(":", emotion, intensity.cast("string")))


def build_prompts(src: DataFrame, attached: DataFrame | None = None, text_col: str = "utterance",
                  id_col: str = "utt_id", max_examples: int = 4, seed: int = 7) -> DataFrame:
    """Prompt per row: cue phrases of its bundle joined by ' and ' (else
    'mixed feelings'), the target length, up to ``max_examples`` of the distinct
    examples of its elements that are free of '*' and of emotion words (of more, a seeded draw), and the rules text.  The model
    call itself is outside the job; completions come back as a table."""
    d = attached if attached is not None else src
    cue_list = F.filter(F.array(*[cue_of(normalize_label(e), to_num(i).cast("int")) for e, i in SLOTS]), lambda c: c.isNotNull())
    cues_desc = F.when(F.size(cue_list) > 0, F.array_join(cue_list, " and ")).otherwise(F.lit("mixed feelings"))
    exs = F.coalesce(F.col("prompt_examples"), F.array().cast("array<string>")) if "prompt_examples" in d.columns \
        else F.array().cast("array<string>")
    block = "|".join(EXAMPLE_BLOCK_WORDS)
    clean = F.filter(exs, lambda x: ~x.contains("*") & ~F.lower(x).rlike(block))
    # de-duplicate on the normalised text, first occurrence kept
    norm = F.transform(clean, lambda x: F.lower(F.trim(x)))
    uniq = F.filter(clean, lambda x, i: F.array_position(norm, F.lower(F.trim(x))) == i + 1)
    d = d.withColumn("__uniq", uniq)
    drawn = F.array_sort(F.transform("__uniq", lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), x)).alias("k"), x.alias("x"))))
    chosen = F.when(F.size("__uniq") > max_examples, F.slice(F.transform(drawn, lambda s: s["x"]), 1, max_examples)).otherwise(F.col("__uniq"))
    ex_str = F.when(F.size(chosen) > 0, F.array_join(F.transform(chosen, lambda x: F.concat(F.lit("- "), x)), "\n")) \
        .otherwise(F.lit("(no clean examples available)"))
    tl = F.coalesce(F.col("avg_length"), F.lit(50.0)).cast("int") if "avg_length" in d.columns else F.lit(50)
    sentiment = F.coalesce(F.col("sentiment"), F.lit("negative"))
    prompt = F.concat(
        F.lit("Rewrite this message as someone talking to a therapist. Show their emotional state through what "
              "they describe, not by naming emotions.\n\nOriginal: \""), F.col(text_col), F.lit("\"\n\nTheir state: "),
        cues_desc, F.lit("\n\n"), ex_str,
        F.lit("\n\nRules:\n- Show feelings through situations, physical reactions, thoughts\n"
              "- Don't use emotion labels (sad, angry, happy, etc.)\n- Natural tone, about "),
        tl.cast("string"), F.lit(" words\n- "), sentiment,
        F.lit(" sentiment\n- Just the message, no explanations\n\nMessage:"))
    return d.select(id_col, cues_desc.alias("cues"), tl.alias("target_len"), F.size(chosen).alias("n_examples"),
                    prompt.alias("prompt"))

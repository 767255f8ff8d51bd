"""Registered adaptation / augmentation / balancing queries.

Source corpus = source-domain rows of ``utterances``; the adaptation target
= target-domain rows of even conversations whose first label is neither joy
nor surprise (so that incompatible labels exist, FIXTURES.md §3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from affect.operators import adapt as D
from affect.operators import balance as B
from affect.operators import labels as L
from affect.operators import rewrite as RW
from affect.operators import text as T
from affect.operators.requests import Ledger
from affect.operators.sampling import draw_long_sql
from affect.plans import sqltext as S
from affect.session import materialize
from affect.sources import io as IO
from affect.sources.fixtures import cte, view

Q: dict = {}
O: dict = {}


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _source(spark, sf):
    return view(spark, "utterances", sf).where(F.col("domain") == "source")


def _target(spark, sf):
    u = view(spark, "utterances", sf)
    return u.where(F.col("domain") == "target")


U = cte("utterances")
SRC = U + """, src AS (SELECT * FROM utterances WHERE domain = 'source'),
tgt AS (SELECT * FROM utterances WHERE domain = 'target'),
sv AS (SELECT DISTINCT emotion FROM (""" + " UNION ALL ".join(
    f"SELECT {S.lenient(e)} AS emotion FROM src" for e, _ in L.SLOTS) + """) WHERE emotion IS NOT NULL AND emotion <> 'nan'),
tv AS (SELECT DISTINCT emotion FROM (""" + " UNION ALL ".join(
    f"SELECT {S.lenient(e)} AS emotion, {S.to_num(i)} AS x FROM tgt" for e, i in L.SLOTS) + """) WHERE emotion IS NOT NULL AND x IS NOT NULL),
comp AS (SELECT emotion, 'compatible' AS status FROM sv WHERE emotion IN (SELECT emotion FROM tv)
  UNION ALL SELECT emotion, 'incompatible' FROM sv WHERE emotion NOT IN (SELECT emotion FROM tv)),
fl AS (SELECT *, (""" + " OR ".join(
    f"coalesce({S.lenient(e)} IN (SELECT emotion FROM comp WHERE status = 'compatible'), false)" for e, _ in L.SLOTS) + \
    """) AS keep_label, (""" + " AND ".join(
    f"({i} IS NULL OR coalesce(TRY_CAST({i} AS DOUBLE) IN (1.0, 2.0, 3.0), false))" for _, i in L.SLOTS) + """) AS keep_intensity FROM src),
sur AS (SELECT * FROM fl WHERE keep_label AND keep_intensity),
pc AS (SELECT emotion, x, count(*) AS cnt FROM (""" + " UNION ALL ".join(
    f"SELECT lower({S.strip(e)}) AS emotion, {S.to_num(i)} AS x FROM sur WHERE {e} IS NOT NULL AND {e} <> '' "
    f"AND {S.to_num(i)} IS NOT NULL" for e, i in L.SLOTS) + """) GROUP BY ALL),
nr AS (SELECT count_if(cnt < 10) AS n_rare FROM pc),
rk AS (SELECT sur.*, ((SELECT n_rare FROM nr) = 0 OR """ + " OR ".join(
    f"coalesce(({e} IS NOT NULL AND {e} <> '' AND {S.to_num(i)} IS NOT NULL AND "
    f"(SELECT cnt FROM pc WHERE pc.emotion = lower({S.strip(e)}) AND pc.x = {S.to_num(i)}) >= 10), false)"
    for e, i in L.SLOTS) + """) AS keep_rare FROM sur)
"""

# ---------------------------------------------------------------- D1-D5
Q["d1_compatible_labels"] = lambda spark, sf: D.compatible_labels(_source(spark, sf), _target(spark, sf))
O["d1_compatible_labels"] = SRC + "SELECT emotion, status FROM comp"


def _flags(spark, sf):
    return D.filter_for_target(_source(spark, sf), _target(spark, sf), min_samples=10)


Q["d2_label_filter"] = lambda spark, sf: D.label_flags(
    _source(spark, sf), D.compatible_labels(_source(spark, sf), _target(spark, sf))).select("utt_id", "keep_label")
O["d2_label_filter"] = SRC + "SELECT utt_id, keep_label FROM fl"

Q["d3_intensity_filter"] = lambda spark, sf: _source(spark, sf).select("utt_id", D.intensity_ok().alias("keep_intensity"))
O["d3_intensity_filter"] = SRC + "SELECT utt_id, keep_intensity FROM fl"

Q["d4_rare_pair_filter"] = lambda spark, sf: _flags(spark, sf)[0].where(
    F.col("keep_label") & F.col("keep_intensity")).select("utt_id", "keep_rare")
O["d4_rare_pair_filter"] = SRC + "SELECT utt_id, keep_rare FROM rk"


def _d5(spark, sf):
    f, comp = _flags(spark, sf)
    return _r6(D.filter_report(f, comp))


Q["d5_filter_report"] = _d5
O["d5_filter_report"] = SRC + """SELECT (SELECT count(*) FROM fl) AS original_size, (SELECT count_if(keep_rare) FROM rk) AS filtered_size,
 (SELECT count_if(NOT keep_label) FROM fl) AS removed_by_emotion,
 (SELECT count_if(keep_label AND NOT keep_intensity) FROM fl) AS removed_by_intensity,
 (SELECT count_if(NOT keep_rare) FROM rk) AS removed_by_rarity,
 (SELECT array_to_string(list_sort(list(emotion)), ',') FROM comp WHERE status = 'compatible') AS compatible_emotions,
 (SELECT coalesce(array_to_string(list_sort(list(emotion)), ','), '') FROM comp WHERE status = 'incompatible') AS incompatible_emotions,
 (SELECT count(*) FROM fl) - (SELECT count_if(keep_rare) FROM rk) AS removed_total,
 round(((SELECT count(*) FROM fl) - (SELECT count_if(keep_rare) FROM rk)) / (SELECT count(*) FROM fl) * 100, 6) AS removed_pct"""


# ---------------------------------------------------------------- D6, D9 (rows-only)
def _patterns(spark, sf):
    tgt = _target(spark, sf)
    pats = T.style_patterns(tgt)
    recs = T.style_records(tgt)
    # examples exist for every label triple present in the target
    keys = recs.select("emotion", "intensity", "sentiment").distinct()
    # looked up by whole intensity: 1.5 has no examples, and every key one row
    keys = keys.where(F.col("intensity") == F.col("intensity").cast("int"))
    ex = (T.examples(tgt, keys, k=3, seed=7).groupBy("emotion", "intensity", "sentiment")
          .agg(F.array_sort(F.collect_list(F.struct("__rank_draw", "text"))).alias("__l"))
          .select("emotion", F.col("intensity").cast("int").alias("intensity"), "sentiment",
                  F.transform("__l", lambda x: x["text"]).alias("texts")))
    # the style tables are small (bounded by label triples); checkpointing
    # them keeps the per-row lookup plans small and recomputation-free
    return tuple(materialize(x) for x in (pats, T.intensifiers(tgt), T.intensifiers(tgt, by_intensity=True), ex))


def _attached(spark, sf):
    src = D.filtered(_flags(spark, sf)[0])
    pats, ei, ii, ex = _patterns(spark, sf)
    return D.attach_patterns(src, pats, ei, ii, ex)


Q["d6_attach_patterns"] = lambda spark, sf: _r6(_attached(spark, sf).select(
    "utt_id", F.array_join("keywords", "|").alias("keywords"), F.array_join("sentence_starters", "|").alias("starters"),
    "avg_length", F.array_join("intensifiers", "|").alias("intensifiers"), F.size("examples").alias("n_examples")))

Q["d9_build_prompts"] = lambda spark, sf: D.build_prompts(None, _attached(spark, sf))

# ---------------------------------------------------------------- D7
Q["d7_sample_n"] = lambda spark, sf: B.sample_n(_source(spark, sf), 100, "utt_id", seed=42).select("utt_id")
O["d7_sample_n"] = U + f"""SELECT utt_id FROM utterances WHERE domain = 'source'
ORDER BY {draw_long_sql(42, 'utt_id', 'sample')}, utt_id LIMIT 100"""

# ---------------------------------------------------------------- D8 / D14 (rows-only; seeded invariants in tests)
def _d8(spark, sf):
    a = _attached(spark, sf)
    aug, _ = B.augment(a, mode="eda", seed=42)
    return aug.select("utt_id", "original", "augmented", F.round("quality", 6).alias("quality"))


Q["d8_rewrite_rules"] = _d8


def _d14(spark, sf):
    a = _attached(spark, sf)
    comp = view(spark, "completions", sf).select("utt_id", "completion")
    aug, det = B.augment(a.join(comp, "utt_id", "left"), mode="mixed", seed=42, completion_col="completion")
    return _r6(det)


Q["d14_augment_details"] = _d14

# ---------------------------------------------------------------- D10-D13 (completions)
C = cte("completions")


def _clean_sql(x: str) -> str:
    """DuckDB text of D10."""
    from affect.functions.clean import WS_CLASS as W
    t = S.strip(x)
    for p in RW.META_SENTENCES:
        t = f"regexp_replace({t}, '{p}', '', 'gis')"
    skip = "[" + ", ".join(f"'{w}'" for w in RW.SKIP_LINE_WORDS) + "]"
    lines = f"string_split({t}, chr(10))"
    keep = (f"list_filter({lines}, lambda ln: {S.strip('ln')} <> '' AND NOT len(list_filter({skip}, "
            f"lambda w: contains(lower({S.strip('ln')}), w))) > 0)")
    t = f"array_to_string({keep}, ' ')"
    t = f"regexp_replace(regexp_replace({t}, '\\*[^*]+\\*', '', 'g'), '\\*+', '', 'g')"
    for p in RW.EMOTION_MENTIONS:
        t = f"regexp_replace({t}, '{p}', '', 'gi')"
    t = f"regexp_replace({S.strip(t)}, '^[\"'']|[\"'']$', '', 'g')"
    t = f"regexp_replace({t}, '{W}+', ' ', 'g')"
    t = f"regexp_replace({t}, '{W}+([.,!?;:])', '\\1', 'g')"
    for ch in RW.PUNCT:
        t = f"regexp_replace({t}, '\\{ch}{{2,}}', '{ch}', 'g')"
    return S.strip(t)


Q["d10_clean_completion"] = lambda spark, sf: view(spark, "completions", sf).select(
    "utt_id", RW.clean_completion("completion").alias("cleaned"))
O["d10_clean_completion"] = C + f"SELECT utt_id, {_clean_sql('completion')} AS cleaned FROM completions"

_LW = "[" + ", ".join(f"'{w}'" for w in RW.LABEL_WORDS) + "]"
_GATE = C + f""", g AS (SELECT utt_id, original, {S.strip("coalesce(completion, '')")} AS raw FROM completions),
g2 AS (SELECT *, {_clean_sql('raw')} AS cleaned FROM g),
gated AS (SELECT utt_id, original, CASE WHEN {S.word_count('raw')} < 3 THEN original
  WHEN len(list_filter({_LW}, lambda w: contains(lower(cleaned), w))) > 0 THEN original
  WHEN lower({S.strip('cleaned')}) = lower({S.strip('original')}) THEN original
  WHEN cleaned = '' THEN original ELSE cleaned END AS output FROM g2)
"""
Q["d11_gate_completion"] = lambda spark, sf: view(spark, "completions", sf).select(
    "utt_id", RW.gate_completion("completion", "original").alias("output"))
O["d11_gate_completion"] = _GATE + "SELECT utt_id, output FROM gated"

_IP = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in RW.INVALID_PHRASES) + "]"


def _valid_sql(x: str) -> str:
    from affect.functions.clean import WS_CLASS as W
    return (f"({x} IS NOT NULL AND length({S.strip(x)}) >= 3 AND len(list_filter({_IP}, lambda p: contains(lower({x}), p))) = 0 "
            f"AND NOT contains({x}, '*') AND NOT regexp_matches(lower({x}), '\\({W}*intensity{W}+\\p{{Nd}}+{W}*\\)'))")


Q["d12_validity"] = lambda spark, sf: view(spark, "completions", sf).select(
    "utt_id", RW.is_valid_output(F.col("completion")).alias("is_valid"))
O["d12_validity"] = C + f"SELECT utt_id, {_valid_sql('completion')} AS is_valid FROM completions"


def _aug_completions(spark, sf):
    c = view(spark, "completions", sf)
    out = RW.gate_completion("completion", "original")
    c = c.withColumn("__o", out).withColumn(
        "augmented", F.when(RW.is_valid_output(F.col("__o")), F.col("__o")).otherwise(F.col("original")))
    return c.withColumn("quality", RW.quality_score("original", "augmented", "target_len")).withColumn("mode", F.lit("llm"))


_AUGC = _GATE + f""", ac AS (SELECT utt_id, original, CASE WHEN {_valid_sql('output')} THEN output ELSE original END AS augmented,
  target_len FROM gated JOIN (SELECT utt_id, target_len FROM completions) USING (utt_id)),
aq AS (SELECT *, CASE WHEN lower({S.strip('original')}) = lower({S.strip('augmented')}) THEN 0.5
  ELSE greatest(0.0, least(1.0, 0.5 - least(0.3, abs({S.word_count('augmented')} - target_len) / greatest(1.0, target_len) * 0.3)))
  END AS quality, 'llm' AS mode FROM ac)
"""
Q["d13_quality_score"] = lambda spark, sf: _r6(_aug_completions(spark, sf).select("utt_id", "augmented", "quality"))
O["d13_quality_score"] = _AUGC + "SELECT utt_id, augmented, round(quality, 6) AS quality FROM aq"

Q["d19_quality_summary"] = lambda spark, sf: B.quality_summary(_aug_completions(spark, sf))
O["d19_quality_summary"] = _AUGC + """SELECT mode, count(*) AS samples, round_even(avg(quality), 3) AS avg_quality,
 round_even(min(quality), 3) AS min_quality, round_even(max(quality), 3) AS max_quality FROM aq GROUP BY mode"""

Q["d20_inspect"] = lambda spark, sf: B.inspect(_aug_completions(spark, sf), 10, "utt_id", seed=42).select(
    "utt_id", "augmented", "valid")
O["d20_inspect"] = _AUGC + f"""SELECT utt_id, augmented, NOT contains(lower(augmented), 'intensity') AND NOT contains(augmented, '*')
 AND NOT contains(lower(augmented), 'rewritten') AS valid FROM aq ORDER BY {draw_long_sql(42, 'utt_id', 'inspect')}, utt_id LIMIT 10"""

# ---------------------------------------------------------------- D15-D18 (source corpus)
_KEYED = U + """, src AS (SELECT * FROM utterances WHERE domain = 'source'),
b AS (SELECT utt_id, list_filter([""" + ", ".join(
    f"{{'e': {S.lenient(e)}, 'i': {S.to_num(i)}}}" for e, i in L.SLOTS) + """], lambda x: x.e IS NOT NULL AND x.i IS NOT NULL) AS bundle FROM src),
k AS (SELECT utt_id, CASE WHEN len(bundle) = 0 THEN 'neutral:2' ELSE array_to_string(list_sort(list_transform(bundle,
  lambda x: x.e || ':' || CAST(CAST(trunc(x.i) AS INTEGER) AS VARCHAR))), '|') END AS bundle_key FROM b),
c AS (SELECT bundle_key, count(*) AS count FROM k GROUP BY 1)
"""


def _plan_sql(mult: float) -> str:
    return f""", p0 AS (SELECT bundle_key, count, CAST(trunc(max(count) OVER () * {mult}) AS BIGINT) AS target FROM c),
p1 AS (SELECT *, CASE WHEN count = target THEN 'keep' WHEN count > target THEN 'downsample' ELSE 'augment' END AS action,
  CASE WHEN count < target THEN target - count ELSE 0 END AS needed FROM p0),
plan AS (SELECT *, needed // count AS full_passes, needed % count AS last_pass, needed AS added FROM p1)
"""


for _m, _suffix in [(1.0, ""), (0.5, "_half")]:
    Q[f"d15_balance_plan{_suffix}"] = (lambda m: lambda spark, sf: B.balance_plan(_source(spark, sf), m))(_m)
    O[f"d15_balance_plan{_suffix}"] = _KEYED + _plan_sql(_m) + """SELECT bundle_key, count, target, action,
 CAST(needed AS BIGINT) AS needed, CAST(full_passes AS BIGINT) AS full_passes, CAST(last_pass AS BIGINT) AS last_pass, CAST(added AS BIGINT) AS added FROM plan"""


def _d16(spark, sf):
    keyed = B.keyed_rows(_source(spark, sf))
    return B.downsample(keyed, B.balance_plan(keyed, 0.5), "utt_id").select("utt_id", "bundle_key")


Q["d16_downsample"] = _d16
O["d16_downsample"] = _KEYED + _plan_sql(0.5) + f""", r AS (SELECT k.utt_id, k.bundle_key, row_number() OVER (PARTITION BY k.bundle_key
  ORDER BY {draw_long_sql(42, 'k.utt_id', 'downsample')}, k.utt_id) AS rn, CASE WHEN plan.action = 'downsample' THEN plan.target ELSE plan.count END AS q
  FROM k JOIN plan USING (bundle_key))
SELECT utt_id, bundle_key FROM r WHERE rn <= q"""


def _d17(spark, sf):
    keyed = B.keyed_rows(_source(spark, sf))
    return B.expansion_rows(keyed, B.balance_plan(keyed, 1.0), "utt_id").select("utt_id", "bundle_key", "pass", "aug_id")


Q["d17_expansion_rows"] = _d17
_DRAW = draw_long_sql(42, "k.utt_id", "STEP").replace("'STEP'", "'pass' || CAST(full_passes + 1 AS VARCHAR)")


def _passes_sql(keyed: str, plan: str) -> str:
    """Whole groups for every full pass, seeded draws for the last one."""
    return f"""SELECT utt_id, bundle_key, CAST(pass AS BIGINT) AS pass FROM (
  SELECT k.utt_id, k.bundle_key, unnest(range(1, full_passes + 1)) AS pass FROM {keyed} k JOIN {plan} USING (bundle_key)
  UNION ALL SELECT utt_id, bundle_key, pass FROM (SELECT k.utt_id, k.bundle_key, full_passes + 1 AS pass, last_pass, row_number() OVER (PARTITION BY k.bundle_key
    ORDER BY {_DRAW}, k.utt_id) AS rn FROM {keyed} k JOIN {plan} USING (bundle_key)) WHERE rn <= last_pass)"""


O["d17_expansion_rows"] = _KEYED + _plan_sql(1.0) + ", xpass AS (" + _passes_sql("k", "plan") + ")\n" \
    "SELECT utt_id, bundle_key, pass, CAST(utt_id AS VARCHAR) || '#' || CAST(pass AS VARCHAR) AS aug_id FROM xpass"


def _d18(spark, sf):
    src = _source(spark, sf)
    keyed = B.keyed_rows(src)
    plan = B.balance_plan(keyed, 1.0)
    kept = B.downsample(keyed, plan, "utt_id").withColumn("utt_id", F.col("utt_id").cast("string"))
    exp = B.expansion_rows(keyed, plan, "utt_id")
    pats, ei, ii, ex = _patterns(spark, sf)
    att = D.attach_patterns(exp, pats, ei, ii, ex)
    aug, _ = B.augment(att.withColumn("utt_id", F.col("aug_id")), mode="eda", seed=42)
    return B.balance_and_expand(kept.drop("bundle"), aug).select(
        F.col("utt_id").cast("string").alias("row_id"), "emotion1", "intensity1", "augmented", "mode")


Q["d18_balance_and_expand"] = _d18


# ---------------------------------------------------------------- D8 steps (oracle-checked one by one)
from affect.functions.clean import WS_CLASS as _W  # noqa: E402
from affect.functions.draws import uniform_sql  # noqa: E402


def _comp_words(spark, sf):
    c = view(spark, "completions", sf)
    return c.withColumn("w", RW.words_of("original")).withColumn("mi", (F.col("utt_id") % 3 + 1).cast("double"))


def _u(step: str) -> str:
    return uniform_sql(42, "utt_id", step)


_CW = C + f""", cw AS (SELECT *, list_filter(regexp_split_to_array(original, '{_W}+'), lambda x: x <> '') AS w,
  CAST(utt_id % 3 + 1 AS DOUBLE) AS mi FROM completions)
"""


def _d8a(spark, sf):
    d = _comp_words(spark, sf).withColumn("ins", F.array(*[F.lit(x) for x in RW.FALLBACK_INTENSIFIERS]))
    d = RW.step_insert_intensifier(d, "w", "ins", RW.intensity_prob(F.col("mi")), "utt_id", 42, "out")
    return d.select("utt_id", F.array_join("out", " ").alias("text"))


Q["d8a_insert_intensifier"] = _d8a
_LV = "[" + ", ".join(f"'{x}'" for x in RW.LINKING_VERBS) + "]"
O["d8a_insert_intensifier"] = _CW + f""", a AS (SELECT utt_id, w, len(w) AS n,
  coalesce(list_position(list_transform(w, lambda x, i: list_contains({_LV}, lower(x)) AND i < len(w)), true), 0) AS hit,
  (['very', 'really', 'so'])[CAST(floor({_u('int_choice')} * 3) AS INTEGER) + 1] AS ins,
  CAST(floor({_u('int_pos')} * (len(w) - 1)) + 1 AS INTEGER) AS rp,
  {_u('int_p')} < coalesce(CASE CAST(round_even(mi, 0) AS INTEGER) WHEN 1 THEN 0.2 WHEN 2 THEN 0.45 WHEN 3 THEN 0.75 END, 0.4) AS go
  FROM cw)
SELECT utt_id, array_to_string(CASE WHEN go AND hit > 0 THEN list_concat(w[1:hit], [ins], w[hit + 1:])
  WHEN go AND n > 2 THEN list_concat(w[1:rp], [ins], w[rp + 1:]) ELSE w END, ' ') AS text FROM a"""


def _d8c(spark, sf):
    d = _comp_words(spark, sf).withColumn("st", F.array(*[F.lit(x) for x in RW.FALLBACK_STARTERS]))
    d = RW.step_replace_starter(d, "w", "st", "utt_id", 42, "out")
    return d.select("utt_id", F.array_join("out", " ").alias("text"))


Q["d8c_replace_starter"] = _d8c
O["d8c_replace_starter"] = _CW + f""", c2 AS (SELECT utt_id, w,
  (['i', 'it', 'this'])[CAST(floor({_u('start_choice')} * 3) AS INTEGER) + 1] AS stc, {_u('start_p')} AS p FROM cw)
SELECT utt_id, array_to_string(CASE WHEN p < 0.25 AND len(w) > 0 AND regexp_full_match(stc, '[\\p{{L}}\\p{{N}}]+')
  THEN list_concat([upper(stc[1]) || lower(stc[2:])], w[2:]) ELSE w END, ' ') AS text FROM c2"""


def _d8d(spark, sf):
    d = RW.step_fit_length(_comp_words(spark, sf), "w", F.col("target_len"), "utt_id", 42, "out")
    return d.select("utt_id", F.col("out").alias("text"))


_EN = "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in RW.ENDINGS) + "]"
Q["d8d_fit_length"] = _d8d
O["d8d_fit_length"] = _CW + f""", d2 AS (SELECT utt_id, w, len(w) AS n, CAST(trunc(target_len) AS INTEGER) AS tl,
  {_EN}[CAST(floor({_u('ending')} * 5) AS INTEGER) + 1] AS ending FROM cw)
SELECT utt_id, CASE WHEN n < tl * 0.6 THEN array_to_string(w, ' ') || ' ' || ending
  WHEN n > tl * 1.6 THEN array_to_string(w[1:greatest(CAST(trunc(tl * 1.2) AS INTEGER), 0)], ' ')
  ELSE array_to_string(w, ' ') END AS text FROM d2"""


def _d8e(spark, sf):
    d = RW.step_first_person(view(spark, "completions", sf), "original", "utt_id", 42, "out")
    return d.select("utt_id", F.col("out").alias("text"))


_FP = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in RW.FIRST_PERSON) + "]"
Q["d8e_first_person"] = _d8e
O["d8e_first_person"] = C + f""", e2 AS (SELECT utt_id, original AS t, substr(original, 1, 1) AS f,
  len(list_filter({_FP}, lambda p: contains(lower(original), p))) > 0 AS fp, {_u('i_p')} AS p FROM completions)
SELECT utt_id, CASE WHEN NOT fp AND p < 0.3 THEN (CASE WHEN f <> '' AND f = upper(f) AND f <> lower(f)
  THEN 'I ' || lower(f) || substr(t, 2) ELSE 'I ' || t END) ELSE t END AS text FROM e2"""

Q["d8f_cleanup"] = lambda spark, sf: view(spark, "completions", sf).select("utt_id", RW.cleanup("completion").alias("text"))
O["d8f_cleanup"] = C + f"""SELECT utt_id, {S.strip(f"regexp_replace(regexp_replace(completion, '\\*+', '', 'g'), '{_W}+', ' ', 'g')")} AS text
FROM completions"""


# ---------------------------------------------------------------- D9 cues and prompt text (no pattern attachment)
Q["d9_prompt_cues"] = lambda spark, sf: D.build_prompts(None, _source(spark, sf))
_CUES = ", ".join("('{}', {}, '{}')".format(e, i, c.replace("'", "''")) for (e, i), c in D.EMOTION_CUES.items())
O["d9_prompt_cues"] = U + f""", src AS (SELECT * FROM utterances WHERE domain = 'source'),
cue(emotion, intensity, cue) AS (VALUES {_CUES}),
c AS (SELECT s.utt_id, s.utterance, s.sentiment, """ + ", ".join(
    f"(SELECT cue FROM cue WHERE cue.emotion = {S.lenient(e)} AND cue.intensity = {S.trunc_int(i)}) AS c{k}"
    for k, (e, i) in enumerate(L.SLOTS)) + """ FROM src s),
d AS (SELECT *, list_filter([c0, c1, c2], lambda x: x IS NOT NULL) AS cl FROM c)
SELECT utt_id, CASE WHEN len(cl) > 0 THEN array_to_string(cl, ' and ') ELSE 'mixed feelings' END AS cues,
 50 AS target_len, 0 AS n_examples,
 'Rewrite this message as someone talking to a therapist. Show their emotional state through what they describe, not by naming emotions.' || chr(10) || chr(10) ||
 'Original: "' || utterance || '"' || chr(10) || chr(10) || 'Their state: ' ||
 (CASE WHEN len(cl) > 0 THEN array_to_string(cl, ' and ') ELSE 'mixed feelings' END) || chr(10) || chr(10) ||
 '(no clean examples available)' || chr(10) || chr(10) || 'Rules:' || chr(10) ||
 '- Show feelings through situations, physical reactions, thoughts' || chr(10) ||
 '- Don''t use emotion labels (sad, angry, happy, etc.)' || chr(10) || '- Natural tone, about 50 words' || chr(10) ||
 '- ' || coalesce(sentiment, 'negative') || ' sentiment' || chr(10) || '- Just the message, no explanations' || chr(10) || chr(10) ||
 'Message:' AS prompt FROM d"""


# ---------------------------------------------------------------- D6 oracle
from affect.plans.pattern_sql import example_ctes, intensifier_ctes, style_ctes  # noqa: E402

_TW = "domain = 'target'"
_DEF_I = "[" + ", ".join(f"'{w}'" for w in D.DEFAULT_INTENSIFIERS) + "]"
_DEF_S = "[" + ", ".join(f"'{w}'" for w in D.DEFAULT_STARTERS) + "]"


def _best(ranked: str) -> str:
    """Terms of (place, term) by their best place, ties by term."""
    terms = f"list_transform(list_sort({ranked}), lambda s: s.t)"
    return f"list_filter({terms}, lambda t, j: list_position({terms}, t) = j)"


_SLOT_SEL = " UNION ALL ".join(
    f"SELECT utt_id, sent, {k + 1} AS slot, CASE WHEN {S.lenient(e)} IS NOT NULL AND {S.to_num(i)} IS NOT NULL "
    f"THEN {S.lenient(e)} END AS e, CASE WHEN {S.lenient(e)} IS NOT NULL AND {S.to_num(i)} IS NOT NULL "
    f"THEN CAST(trunc({S.to_num(i)}) AS INTEGER) END AS i FROM fs" for k, (e, i) in enumerate(L.SLOTS))
_WSR = f"regexp_split_to_array(t, '{_W}+')"
O["d6_attach_patterns"] = SRC + style_ctes(_TW, "p_") + intensifier_ctes(_TW, False, "eo_") + \
    intensifier_ctes(_TW, True, "ia_") + example_ctes("p_rec", 3, 7, "ex_") + f""",
fs AS (SELECT *, coalesce(lower(sentiment), 'negative') AS sent FROM rk WHERE keep_rare),
sl0 AS ({_SLOT_SEL}),
emp AS (SELECT utt_id, bool_and(e IS NULL) AS empty FROM sl0 GROUP BY utt_id),
sl AS (SELECT sl0.utt_id, sl0.sent, sl0.slot, CASE WHEN emp.empty AND sl0.slot = 1 THEN 'neutral' ELSE sl0.e END AS e,
  CASE WHEN emp.empty AND sl0.slot = 1 THEN 2 ELSE sl0.i END AS i FROM sl0 JOIN emp USING (utt_id)),
el AS (SELECT sl.utt_id, sl.slot, sl.e, pat.keywords AS kw, pat.starters AS st, pat.avg_length AS al,
  coalesce(ia.intensifiers, []::VARCHAR[]) AS ia, coalesce(eo.intensifiers, []::VARCHAR[]) AS eo, coalesce(ex.texts, []::VARCHAR[]) AS ex
  FROM sl LEFT JOIN p_pat pat ON pat.emotion = sl.e AND pat.intensity_key = sl.i AND pat.sentiment = sl.sent
  LEFT JOIN ia_out ia ON ia.emotion = sl.e AND ia.intensity = sl.i
  LEFT JOIN eo_out eo ON eo.emotion = sl.e
  LEFT JOIN ex_out ex ON ex.emotion = sl.e AND ex.intensity = sl.i AND ex.sentiment = sl.sent
  WHERE sl.e IS NOT NULL),
els AS (SELECT utt_id, list({{'e': e, 'kw': kw, 'st': st, 'al': al, 'ia': ia, 'eo': eo, 'ex': ex}} ORDER BY slot) AS els
  FROM el GROUP BY utt_id),
mg AS (SELECT utt_id, els,
  {_best("flatten(list_transform(els, lambda x: list_transform(coalesce(x.kw, []::VARCHAR[]), lambda t, j: {'r': len(x.kw) - j, 't': t})))")} AS kwu,
  {_best("flatten(list_transform(els, lambda x: list_transform(coalesce(x.st, []::VARCHAR[]), lambda t, j: {'r': j, 't': t})))")} AS stu,
  flatten(list_transform(els, lambda x: x.ex)) AS exs,
  list_filter(els, lambda x: x.al IS NOT NULL) AS matched,
  {_best("list_reduce(els, lambda acc, x: CASE WHEN len(x.ia) > 0 THEN acc || list_transform(x.ia, lambda t, j: {'r': CAST(j AS BIGINT), 't': t}) "
         "WHEN len(x.eo) > 0 THEN acc || list_transform(x.eo, lambda t, j: {'r': CAST(j AS BIGINT), 't': t}) WHEN len(acc) = 0 THEN "
         f"list_transform({_DEF_I}, lambda t, j: {{'r': CAST(j AS BIGINT), 't': t}}) ELSE acc END, []::STRUCT(r BIGINT, t VARCHAR)[])")} AS ints
  FROM els),
wd AS (SELECT mg.utt_id, u.w, u.pos FROM mg, LATERAL (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos
   FROM (SELECT flatten(list_transform(mg.exs, lambda t: list_filter(regexp_split_to_array(lower(t), '{_W}+'), lambda w: w <> ''))) AS ws)) u),
wc AS (SELECT utt_id, w, count(*) AS c, min(pos) AS fp FROM wd GROUP BY ALL),
cw AS (SELECT utt_id, list(w ORDER BY c DESC, fp) AS ws FROM wc GROUP BY utt_id),
att AS (SELECT mg.utt_id,
 (CASE WHEN len(kwu) = 0 AND len(exs) > 0 THEN coalesce(cw.ws, [])[1:20] ELSE kwu END)[1:30] AS keywords,
 (CASE WHEN len(stu) = 0 THEN {_DEF_S} ELSE stu END)[1:15] AS starters,
 CASE WHEN len(matched) > 0 THEN list_sum(list_transform(matched, lambda x: x.al)) / len(matched)
   WHEN len(exs) > 0 THEN list_sum(list_transform(exs, lambda t: len(list_filter({_WSR}, lambda w: w <> '')))) / len(exs)
   ELSE 50.0 END AS avg_length,
 ints[1:15] AS intensifiers, exs[1:6] AS examples, exs AS prompt_examples
FROM mg LEFT JOIN cw USING (utt_id))
"""
_D6_ATT = O["d6_attach_patterns"]
O["d6_attach_patterns"] = _D6_ATT + """SELECT utt_id, array_to_string(keywords, '|') AS keywords, array_to_string(starters, '|') AS starters,
 round(avg_length, 6) AS avg_length, array_to_string(intensifiers, '|') AS intensifiers, CAST(len(examples) AS INTEGER) AS n_examples
FROM att"""


# ---------------------------------------------------------------- D14 (llm mode) and D18 (identity mode) with oracles
def _d14_completion(spark, sf):
    src = _source(spark, sf)
    comp = view(spark, "completions", sf).select("utt_id", "completion")
    rows = (src.join(comp, "utt_id", "left").withColumn("keywords", F.lit(None).cast("array<string>"))
               .withColumn("avg_length", F.lit(None).cast("double")))
    aug, det = B.augment(rows, mode="llm", seed=42, completion_col="completion")
    return _r6(aug.select("utt_id", "sentiment", "original", "augmented", "quality", "mode"))


Q["d14_augment_completion"] = _d14_completion
O["d14_augment_completion"] = _GATE.replace(C, cte("utterances", "completions"), 1) + f""", s AS (SELECT * FROM utterances WHERE domain = 'source'),
j AS (SELECT s.utt_id, coalesce(s.sentiment, 'negative') AS sentiment, coalesce(s.utterance, '') AS original,
  CASE WHEN {S.word_count('raw')} < 3 THEN coalesce(s.utterance, '')
   WHEN len(list_filter({_LW}, lambda w: contains(lower(g2.cleaned), w))) > 0 THEN coalesce(s.utterance, '')
   WHEN lower({S.strip('g2.cleaned')}) = lower({S.strip("coalesce(s.utterance, '')")}) THEN coalesce(s.utterance, '')
   WHEN g2.cleaned = '' THEN coalesce(s.utterance, '') ELSE g2.cleaned END AS out
  FROM s LEFT JOIN g2 USING (utt_id)),
v AS (SELECT *, CASE WHEN {_valid_sql('out')} THEN out ELSE original END AS augmented FROM j)
SELECT utt_id, sentiment, original, augmented,
 round(CASE WHEN lower({S.strip('original')}) = lower({S.strip('augmented')}) THEN 0.5
  ELSE greatest(0.0, least(1.0, 0.5 - least(0.3, abs({S.word_count('augmented')} - 50.0) / 50.0 * 0.3))) END, 6) AS quality,
 'llm' AS mode FROM v"""


def _d18_identity(spark, sf):
    src = _source(spark, sf)
    keyed = B.keyed_rows(src)
    plan = B.balance_plan(keyed, 1.0)
    kept = B.downsample(keyed, plan, "utt_id").withColumn("utt_id", F.col("utt_id").cast("string"))
    exp = B.expansion_rows(keyed, plan, "utt_id").withColumn("utt_id", F.col("aug_id"))
    aug, _ = B.augment(exp.withColumn("keywords", F.lit(None).cast("array<string>"))
                          .withColumn("avg_length", F.lit(None).cast("double")), mode="none", seed=42)
    return _r6(B.balance_and_expand(kept, aug).select(
        F.col("utt_id").alias("row_id"), "emotion1", "intensity1", "original", "augmented", "quality", "mode"))


Q["d18_balance_identity"] = _d18_identity
O["d18_balance_identity"] = O["d17_expansion_rows"].rsplit("\n", 1)[0] + """,
ex AS (""" + O["d17_expansion_rows"].rsplit("\n", 1)[1] + """),
s AS (SELECT * FROM utterances WHERE domain = 'source')
SELECT CAST(utt_id AS VARCHAR) AS row_id, emotion1, intensity1, NULL AS original, NULL AS augmented, NULL::DOUBLE AS quality,
  NULL AS mode FROM s
UNION ALL SELECT ex.aug_id, s.emotion1, s.intensity1, coalesce(s.utterance, ''), coalesce(s.utterance, ''), 0.5, 'none'
  FROM ex JOIN s USING (utt_id)"""


# ---------------------------------------------------------------- D8 full chain oracle (eda mode over D6 output)
def _uid(step: str, id_expr: str = "utt_id") -> str:
    return uniform_sql(42, id_expr, step)


_META = "[" + ", ".join(f"'{w}'" for w in RW.META_WORDS) + "]"
_FI = "[" + ", ".join(f"'{w}'" for w in RW.FALLBACK_INTENSIFIERS) + "]"
_FS = "[" + ", ".join(f"'{w}'" for w in RW.FALLBACK_STARTERS) + "]"
_BUNDLE_INTS = "list_filter([" + ", ".join(
    f"CASE WHEN {S.lenient(e)} IS NOT NULL AND {S.to_num(i)} IS NOT NULL THEN CAST(trunc({S.to_num(i)}) AS DOUBLE) END"
    for e, i in L.SLOTS) + "], lambda x: x IS NOT NULL)"
O["d8_rewrite_rules"] = _D6_ATT + f""",
r0 AS (SELECT fs.utt_id, coalesce(fs.utterance, '') AS t, att.keywords AS kw0, att.starters AS st0, att.intensifiers AS in0,
  att.avg_length AS al, {_BUNDLE_INTS} AS bi FROM fs JOIN att USING (utt_id)),
r1 AS (SELECT *, len(kw0) = 0 AND len(st0) = 0 AND len(in0) = 0 AS nothing,
  CASE WHEN len(bi) > 0 THEN list_sum(bi) / len(bi) ELSE 2.0 END AS mi FROM r0),
r2 AS (SELECT utt_id, t, al, kw0, CASE WHEN nothing THEN {_FI} ELSE in0 END AS ins, CASE WHEN nothing THEN {_FS} ELSE st0 END AS st,
  list_filter(kw0, lambda k: NOT list_contains({_META}, lower(k))) AS kw,
  list_filter(regexp_split_to_array(t, '{_W}+'), lambda x: x <> '') AS w0,
  coalesce(CASE CAST(round_even(mi, 0) AS INTEGER) WHEN 1 THEN 0.2 WHEN 2 THEN 0.45 WHEN 3 THEN 0.75 END, 0.4) AS p FROM r1),
a1 AS (SELECT *, coalesce(list_position(list_transform(w0, lambda x, i: list_contains({_LV}, lower(x)) AND i < len(w0)), true), 0) AS hit,
  ins[CAST(floor({_uid('int_choice')} * len(ins)) AS INTEGER) + 1] AS ic,
  CAST(floor({_uid('int_pos')} * (len(w0) - 1)) + 1 AS INTEGER) AS rp, len(ins) > 0 AND {_uid('int_p')} < p AS go FROM r2),
a2 AS (SELECT *, CASE WHEN go AND hit > 0 THEN list_concat(w0[1:hit], [ic], w0[hit + 1:])
  WHEN go AND len(w0) > 2 THEN list_concat(w0[1:rp], [ic], w0[rp + 1:]) ELSE w0 END AS w1 FROM a1),
b1 AS (SELECT *, list_sort(list_transform(list_filter(kw, lambda k: NOT contains(lower(array_to_string(w1, ' ')), lower(k))),
  lambda k: {{'d': {uniform_sql(42, "CAST(utt_id AS VARCHAR) || ':' || k", 'kw_pick')}, 'k': k}})) AS ranked,
  least(greatest(1, CAST(trunc(len(w1) / 12) AS INTEGER)), 2) AS m FROM a2),
b2 AS (SELECT *, list_transform(ranked[1:least(len(ranked), m)], lambda s, j: {{'k': s.k,
  'u': {uniform_sql(42, "CAST(utt_id AS VARCHAR) || ':' || CAST(j - 1 AS VARCHAR)", 'kw_pos')}}}) AS chosen FROM b1),
b3 AS (SELECT *, CASE WHEN len(kw) > 0 THEN list_reduce(chosen, lambda acc, s: list_concat(
  acc[1:CAST(floor(s.u * (len(acc) + 1)) AS INTEGER)], [s.k], acc[CAST(floor(s.u * (len(acc) + 1)) AS INTEGER) + 1:]), w1)
  ELSE w1 END AS w2 FROM b2),
c1 AS (SELECT *, list_filter(st, lambda x: x NOT IN ('*', '[', ']')) AS stf FROM b3),
c2 AS (SELECT *, stf[CAST(floor({_uid('start_choice')} * len(stf)) AS INTEGER) + 1] AS stc FROM c1),
c3 AS (SELECT *, CASE WHEN len(st) > 0 AND {_uid('start_p')} < 0.25 AND len(w2) > 0
  AND coalesce(regexp_full_match(stc, '[\\p{{L}}\\p{{N}}]+'), false)
  THEN list_concat([upper(stc[1]) || lower(stc[2:])], w2[2:]) ELSE w2 END AS w3 FROM c2),
d1 AS (SELECT *, CAST(trunc(coalesce(al, 50.0)) AS INTEGER) AS tl, {_EN}[CAST(floor({_uid('ending')} * 5) AS INTEGER) + 1] AS ending FROM c3),
d2 AS (SELECT *, CASE WHEN len(w3) < tl * 0.6 THEN array_to_string(w3, ' ') || ' ' || ending
  WHEN len(w3) > tl * 1.6 THEN array_to_string(w3[1:greatest(CAST(trunc(tl * 1.2) AS INTEGER), 0)], ' ')
  ELSE array_to_string(w3, ' ') END AS t4 FROM d1),
e1 AS (SELECT *, substr(t4, 1, 1) AS f, len(list_filter({_FP}, lambda q: contains(lower(t4), q))) > 0 AS fp FROM d2),
e2 AS (SELECT *, CASE WHEN NOT fp AND {_uid('i_p')} < 0.3 THEN (CASE WHEN f <> '' AND f = upper(f) AND f <> lower(f)
  THEN 'I ' || lower(f) || substr(t4, 2) ELSE 'I ' || t4 END) ELSE t4 END AS t5 FROM e1),
f1 AS (SELECT *, {S.strip(f"regexp_replace(regexp_replace(t5, '\\*+', '', 'g'), '{_W}+', ' ', 'g')")} AS out FROM e2),
g1 AS (SELECT *, CASE WHEN {_valid_sql('out')} THEN out ELSE t END AS augmented FROM f1)
SELECT utt_id, t AS original, augmented,
 round(CASE WHEN lower({S.strip('t')}) = lower({S.strip('augmented')}) THEN 0.5
  ELSE greatest(0.0, least(1.0, 0.5 - least(0.3, abs({S.word_count('augmented')} - coalesce(al, 50.0)) / greatest(1.0, coalesce(al, 50.0)) * 0.3)
   + least(0.4, len(list_filter(kw0[1:5], lambda k: contains(lower(augmented), lower(k)))) * 0.12))) END, 6) AS quality
FROM g1"""


# ---------------------------------------------------------------- D9 with attached patterns (oracle)
_BLOCK = "|".join(D.EXAMPLE_BLOCK_WORDS)
O["d9_build_prompts"] = _D6_ATT + f""",
cue(emotion, intensity, cue) AS (VALUES {_CUES}),
q0 AS (SELECT fs.utt_id, fs.utterance, fs.sentiment, att.prompt_examples AS exs, att.avg_length, """ + ", ".join(
    f"(SELECT cue FROM cue WHERE cue.emotion = {S.lenient(e)} AND cue.intensity = {S.trunc_int(i)}) AS c{k}"
    for k, (e, i) in enumerate(L.SLOTS)) + f""" FROM fs JOIN att USING (utt_id)),
q1 AS (SELECT *, list_filter([c0, c1, c2], lambda x: x IS NOT NULL) AS cl,
  list_filter(exs, lambda x: NOT contains(x, '*') AND NOT regexp_matches(lower(x), '{_BLOCK}')) AS cln FROM q0),
q2 AS (SELECT *, list_transform(cln, lambda x: lower(trim(x))) AS nrm FROM q1),
qu AS (SELECT *, list_filter(cln, lambda x, i: list_position(nrm, lower(trim(x))) = i) AS uq FROM q2),
q3 AS (SELECT *, CASE WHEN len(uq) > 4 THEN list_transform(list_sort(list_transform(uq, lambda x: {{'k': md5(concat_ws(':', '7', CAST(utt_id AS VARCHAR), x)), 'x': x}})), lambda s: s.x)[1:4] ELSE uq END AS chosen,
  CAST(trunc(coalesce(avg_length, 50.0)) AS INTEGER) AS tl,
  CASE WHEN len(cl) > 0 THEN array_to_string(cl, ' and ') ELSE 'mixed feelings' END AS cues FROM qu)
SELECT utt_id, cues, tl AS target_len, CAST(len(chosen) AS INTEGER) AS n_examples,
 'Rewrite this message as someone talking to a therapist. Show their emotional state through what they describe, not by naming emotions.' || chr(10) || chr(10) ||
 'Original: "' || utterance || '"' || chr(10) || chr(10) || 'Their state: ' || cues || chr(10) || chr(10) ||
 (CASE WHEN len(chosen) > 0 THEN array_to_string(list_transform(chosen, lambda x: '- ' || x), chr(10)) ELSE '(no clean examples available)' END)
 || chr(10) || chr(10) || 'Rules:' || chr(10) ||
 '- Show feelings through situations, physical reactions, thoughts' || chr(10) ||
 '- Don''t use emotion labels (sad, angry, happy, etc.)' || chr(10) || '- Natural tone, about ' || CAST(tl AS VARCHAR) || ' words' || chr(10) ||
 '- ' || coalesce(sentiment, 'negative') || ' sentiment' || chr(10) || '- Just the message, no explanations' || chr(10) || chr(10) ||
 'Message:' AS prompt FROM q3"""


# ---------------------------------------------------------------- D14 mixed mode details (oracle)
_BSTR = ("list_filter([" + ", ".join(
    f"CASE WHEN {S.lenient(e)} IS NOT NULL AND {S.to_num(i)} IS NOT NULL THEN {S.lenient(e)} || ':' || CAST({S.to_num(i)} AS VARCHAR) END"
    for e, i in L.SLOTS) + "], lambda x: x IS NOT NULL)")
O["d14_augment_details"] = O["d8_rewrite_rules"].split(",\ng1 AS (")[0].replace(U, cte("utterances", "completions"), 1) + f""",
gc AS (SELECT f1.*, {S.strip("coalesce(c.completion, '')")} AS raw FROM f1 LEFT JOIN completions c USING (utt_id)),
gc2 AS (SELECT *, {_clean_sql('raw')} AS cleaned FROM gc),
gc3 AS (SELECT *, CASE WHEN {S.word_count('raw')} < 3 THEN t
   WHEN len(list_filter({_LW}, lambda w: contains(lower(cleaned), w))) > 0 THEN t
   WHEN lower({S.strip('cleaned')}) = lower({S.strip('t')}) THEN t WHEN cleaned = '' THEN t ELSE cleaned END AS llm FROM gc2),
mx AS (SELECT *, CASE WHEN {_uid('mixed')} < 0.65 THEN llm ELSE out END AS o2 FROM gc3),
g1 AS (SELECT *, {_valid_sql('o2')} AS v, CASE WHEN {_valid_sql('o2')} THEN o2 ELSE t END AS augmented FROM mx),
bs AS (SELECT utt_id, {_BSTR} AS b FROM fs)
SELECT g1.utt_id AS sample_idx, CAST({S.word_count('t')} AS INTEGER) AS original_len,
 CAST({S.word_count('augmented')} AS INTEGER) AS transformed_len,
 CASE WHEN len(b) = 0 THEN 'neutral:2.0' ELSE array_to_string(b, ',') END AS bundle,
 round(CASE WHEN lower({S.strip('t')}) = lower({S.strip('augmented')}) THEN 0.5
  ELSE greatest(0.0, least(1.0, 0.5 - least(0.3, abs({S.word_count('augmented')} - coalesce(al, 50.0)) / greatest(1.0, coalesce(al, 50.0)) * 0.3)
   + least(0.4, len(list_filter(kw0[1:5], lambda k: contains(lower(augmented), lower(k)))) * 0.12))) END, 6) AS quality,
 'mixed' AS mode, {_valid_sql('augmented')} AS is_valid, NOT v AS reverted
FROM g1 JOIN bs USING (utt_id)"""


# ---------------------------------------------------------------- D18 rewrite mode (oracle)
_FS_LINE = "fs AS (SELECT *, coalesce(lower(sentiment), 'negative') AS sent FROM rk WHERE keep_rare),"
_XROWS = """xb AS (SELECT utt_id, list_filter([""" + ", ".join(
    f"{{'e': {S.lenient(e)}, 'i': {S.to_num(i)}}}" for e, i in L.SLOTS) + """], lambda x: x.e IS NOT NULL AND x.i IS NOT NULL) AS bundle FROM src),
xk AS (SELECT utt_id, CASE WHEN len(bundle) = 0 THEN 'neutral:2' ELSE array_to_string(list_sort(list_transform(bundle,
  lambda x: x.e || ':' || CAST(CAST(trunc(x.i) AS INTEGER) AS VARCHAR))), '|') END AS bundle_key FROM xb),
xc AS (SELECT bundle_key, count(*) AS count FROM xk GROUP BY 1),
xp0 AS (SELECT bundle_key, count, CAST(trunc(max(count) OVER () * 1.0) AS BIGINT) AS target FROM xc),
xp1 AS (SELECT *, CASE WHEN count < target THEN target - count ELSE 0 END AS needed FROM xp0),
xplan AS (SELECT *, needed // count AS full_passes, needed % count AS last_pass FROM xp1),
xr AS (""" + _passes_sql("xk", "xplan") + """),
fs AS (SELECT CAST(s.utt_id AS VARCHAR) || '#' || CAST(xr.pass AS VARCHAR) AS utt_id, s.utterance, s.sentiment,
  s.emotion1, s.intensity1, s.emotion2, s.intensity2, s.emotion3, s.intensity3, coalesce(lower(s.sentiment), 'negative') AS sent
  FROM xr JOIN src s ON s.utt_id = xr.utt_id),"""
assert _FS_LINE in O["d8_rewrite_rules"]
O["d18_balance_and_expand"] = O["d8_rewrite_rules"].replace(_FS_LINE, _XROWS, 1).split("\nSELECT utt_id, t AS original")[0] + """
SELECT CAST(utt_id AS VARCHAR) AS row_id, emotion1, intensity1, NULL AS augmented, NULL AS mode FROM src
UNION ALL SELECT g1.utt_id, fs.emotion1, fs.intensity1, g1.augmented, 'eda' FROM g1 JOIN fs USING (utt_id)"""


# ---------------------------------------------------------------- D18 with completions
def _answers(spark, sf, ledger):
    """Stand-in for the model: completions of the same utterance. Every tenth request has no answer, every seventh a
    second attempt, and each answer stands twice."""
    n = F.col("utt_id").cast("long") + F.col("pass").cast("long")
    asked = ledger.pending().select("request_id", "prompt_id", F.split("request_id", "#")[0].alias("utt_id"), F.split("request_id", "#")[1].alias("pass"))
    made = asked.join(view(spark, "completions", sf).select(F.col("utt_id").cast("string").alias("utt_id"), "completion"), "utt_id").where(n % 10 != 0)
    tries = F.array(F.struct(F.lit(1).alias("attempt"), F.col("completion")), F.struct(F.lit(1).alias("attempt"), F.col("completion")))
    again = F.array(F.struct(F.lit(2).alias("attempt"), F.lit("ok").alias("completion")))
    return made.select("request_id", "prompt_id", F.inline(F.when(n % 7 == 0, F.concat(again, tries)).otherwise(tries)))


def _d18_completions(mode: str):
    def run(spark, sf):
        keyed = B.keyed_rows(_source(spark, sf))
        plan = B.balance_plan(keyed, 1.0)
        kept = B.downsample(keyed, plan, "utt_id").withColumn("utt_id", F.col("utt_id").cast("string"))
        rows = B.expansion_rows(keyed, plan, "utt_id").withColumn("prompt", F.concat(F.lit("Rewrite: "), F.coalesce("utterance", F.lit(""))))
        ledger = Ledger(spark, IO.scratch_path(spark, "ledger"))
        ledger.ask(rows, "aug_id", "prompt")
        ledger.record(_answers(spark, sf, ledger))
        ledger.ask(rows, "aug_id", "prompt")  # a second start of the job asks nothing twice
        done = ledger.attach(rows, "aug_id", "prompt").drop("prompt")
        if mode == "mixed":
            done = D.attach_patterns(done, *_patterns(spark, sf))
        else:
            done = done.withColumn("keywords", F.lit(None).cast("array<string>")).withColumn("avg_length", F.lit(None).cast("double"))
        aug, _ = B.augment(done.withColumn("utt_id", F.col("aug_id")), mode=mode, seed=42, completion_col="completion")
        return B.balance_and_expand(kept.drop("bundle"), aug).select(F.col("utt_id").cast("string").alias("row_id"), "emotion1", "intensity1", "augmented", "mode")
    return run


for _mode in ("llm", "mixed"):
    Q[f"d18_balance_{_mode}"] = _d18_completions(_mode)
    _taken = "CASE WHEN (ex.utt_id + ex.pass) % 10 = 0 OR (ex.utt_id + ex.pass) % 7 = 0 THEN a.original ELSE a.augmented END"
    if _mode == "mixed":
        _taken = f"CASE WHEN {uniform_sql(42, 'ex.aug_id', 'mixed')} < 0.65 THEN {_taken} ELSE e.augmented END"
    O[f"d18_balance_{_mode}"] = f"""WITH ex AS ({O['d17_expansion_rows']}), a AS ({O['d14_augment_completion']}),
src AS ({cte('utterances')} SELECT utt_id, emotion1, intensity1 FROM utterances WHERE domain = 'source'){
    f", e AS (SELECT row_id, augmented FROM ({O['d18_balance_and_expand']}) WHERE mode = 'eda')" if _mode == "mixed" else ""}
SELECT CAST(utt_id AS VARCHAR) AS row_id, emotion1, intensity1, NULL AS augmented, NULL AS mode FROM src
UNION ALL SELECT ex.aug_id, src.emotion1, src.intensity1, {_taken}, '{_mode}' FROM ex JOIN src USING (utt_id) JOIN a USING (utt_id){
    " JOIN e ON e.row_id = ex.aug_id" if _mode == "mixed" else ""}"""

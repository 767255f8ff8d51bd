"""Registered text-mining queries (T1-T11) over the target-domain part of
the ``utterances`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from affect.functions.clean import WS_CLASS
from affect.operators import labels as L
from affect.operators import text as T
from affect.operators.sampling import draw_long_sql
from affect.plans import sqltext as S
from affect.sources.fixtures import cte, view

Q: dict = {}
O: dict = {}


def _target(spark, sf):
    return view(spark, "utterances", sf).where(F.col("domain") == "target")


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _docs(spark, sf):
    recs = T.style_records(_target(spark, sf))
    return T.group_docs(recs, T.style_groups(recs))


SW = "[" + ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in T.english_stop_words()) + "]"
U = cte("utterances")
REC = U + f""", u AS (SELECT * FROM utterances WHERE domain = 'target'),
rec AS (SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT utt_id, coalesce(utterance, 'nan') AS text, lower({S.strip('sentiment')}) AS sentiment, {k + 1} AS slot, "
    f"{S.lenient(e)} AS emotion, {S.to_num(i)} AS intensity FROM u" for k, (e, i) in enumerate(L.SLOTS)) + """)
  WHERE emotion IS NOT NULL AND intensity IS NOT NULL AND sentiment IS NOT NULL),
g0 AS (SELECT emotion, intensity, sentiment, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) >= 5),
grp AS (SELECT emotion, intensity_key, sentiment, intensity FROM (SELECT *, CAST(trunc(intensity) AS INTEGER) AS intensity_key,
  row_number() OVER (PARTITION BY emotion, CAST(trunc(intensity) AS INTEGER), sentiment ORDER BY intensity DESC) AS rn FROM g0) WHERE rn = 1),
docs AS (SELECT r.*, g.intensity_key FROM rec r JOIN grp g USING (emotion, intensity, sentiment))
"""
K = "emotion, intensity_key, sentiment"


def tfidf_sql(docs: str, keys: str, doc: str, terms_expr: str, max_features: int, prefix: str = "") -> str:
    """DuckDB text of the per-group TF-IDF scores -> ``{prefix}sc(keys, term, score)``."""
    p = prefix
    return f""",
{p}trm AS (SELECT {keys}, {doc}, {terms_expr} AS terms FROM {docs}),
{p}tf AS (SELECT {keys}, {doc}, term, count(*) AS tf FROM (SELECT {keys}, {doc}, unnest(terms) AS term FROM {p}trm) GROUP BY ALL),
{p}nd AS (SELECT {keys}, count(*) AS n FROM {docs} GROUP BY ALL),
{p}dfq AS (SELECT {keys}, term, count(*) AS df, sum(tf) AS ctf FROM {p}tf GROUP BY ALL),
{p}voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ctf DESC, term) AS rn FROM {p}dfq WHERE df >= 2)
  WHERE rn <= {max_features}),
{p}x AS (SELECT {p}tf.*, {p}nd.n, {p}tf.tf * (ln((1.0 + {p}nd.n) / (1.0 + {p}voc.df)) + 1.0) AS v FROM {p}tf
  JOIN {p}voc USING ({keys}, term) JOIN {p}nd USING ({keys})),
{p}xn AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY {keys}, {doc})) AS nv FROM {p}x),
{p}sc AS (SELECT {keys}, term, round(sum(nv) / max(n), 12) AS score FROM {p}xn GROUP BY ALL)"""


_WORD_TERMS = (f"list_filter(regexp_extract_all(lower(text), '{T.WORD_TOKEN}'), lambda t: NOT list_contains({SW}, t))")
KW = REC + f""", tk AS (SELECT {K}, utt_id, slot, {_WORD_TERMS} AS tk FROM docs)""" + tfidf_sql(
    "tk", K, "utt_id, slot", "tk || list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])", 50) + f""",
top AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score DESC, term) AS r FROM sc),
kw AS (SELECT {K}, list(term ORDER BY r DESC) AS keywords FROM top WHERE r <= 20 GROUP BY ALL)
"""

# ---------------------------------------------------------------- T1
Q["t1_style_groups"] = lambda spark, sf: T.style_groups(T.style_records(_target(spark, sf)))
O["t1_style_groups"] = REC + "SELECT emotion, intensity_key, sentiment, intensity FROM grp"

# ---------------------------------------------------------------- T2, T4, T5
def _profile(spark, sf):
    p = T.style_profile(_docs(spark, sf))
    return _r6(p.select(*T.GROUP_KEY, "sample_count", "avg_length", "question_ratio", "exclamation_ratio",
                        *[F.element_at("pronoun_freq", F.lit(x)).alias(f"pronoun_{x}") for x in T.PRONOUNS]))


def _cnt(p: str) -> str:
    return f"CAST((length(lower(text)) - length(replace(lower(text), '{p}', ''))) / {len(p)} AS INTEGER)"


Q["t2_t5_style_profile"] = _profile
O["t2_t5_style_profile"] = REC + f"""SELECT {K}, count(*) AS sample_count, round(avg({S.word_count('text')}), 6) AS avg_length,
 round(avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END), 6) AS question_ratio,
 round(avg(CASE WHEN contains(text, '!') THEN 1.0 ELSE 0.0 END), 6) AS exclamation_ratio, """ + ", ".join(
    f"round(avg({_cnt(' ' + x + ' ')} + {_cnt(x + ' ')}), 6) AS pronoun_{x}" for x in T.PRONOUNS) + " FROM docs GROUP BY ALL"

# ---------------------------------------------------------------- T3
Q["t3_sentence_starters"] = lambda spark, sf: T.sentence_starters(_docs(spark, sf)).select(
    *T.GROUP_KEY, F.array_join("sentence_starters", "|").alias("sentence_starters"))
_FIRST = f"lower(string_split_regex(regexp_replace(s, '^{WS_CLASS}+', ''), '{WS_CLASS}+')[1])"
O["t3_sentence_starters"] = REC + f""", se AS (SELECT {K}, utt_id, slot, u.spos, u.s FROM docs,
  LATERAL (SELECT unnest(string_split_regex(text, '[.!?]+')) AS s, unnest(range(0, len(string_split_regex(text, '[.!?]+')))) AS spos) u),
st AS (SELECT {K}, utt_id, slot, spos, {_FIRST} AS starter FROM se),
c AS (SELECT {K}, starter, count(*) AS cnt, min((utt_id, slot, spos)) AS seen FROM st WHERE starter IS NOT NULL AND starter <> ''
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY cnt DESC, seen) AS rn FROM c)
SELECT {K}, array_to_string(list(starter ORDER BY rn), '|') AS sentence_starters FROM r WHERE rn <= 15 GROUP BY ALL"""

# ---------------------------------------------------------------- T6
Q["t6_tfidf_keywords"] = lambda spark, sf: T.tfidf_keywords(_docs(spark, sf)).select(
    *T.GROUP_KEY, F.array_join("keywords", "|").alias("keywords"))
O["t6_tfidf_keywords"] = KW + f"SELECT {K}, array_to_string(keywords, '|') AS keywords FROM kw"

# ---------------------------------------------------------------- T7 / T8
_ASCII_TERMS = f"list_filter(regexp_extract_all(lower(text), '{T.WORD_RUN}'), lambda t: regexp_full_match(t, '[a-zA-Z]+'))"


def _slot_sql(with_int: bool) -> str:
    parts = []
    for k, (e, i) in enumerate(L.SLOTS):
        cols = f"{k + 1} AS slot, lower({S.strip(e)}) AS emotion, utt_id, coalesce(utterance, 'nan') AS text"
        if with_int:
            cols += f", {S.to_num(i)} AS intensity"
        parts.append(f"SELECT {cols} FROM u")
    cond = "emotion IS NOT NULL AND emotion <> ''" + (" AND intensity IS NOT NULL" if with_int else "")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE {cond}"


def _intens_sql(with_int: bool) -> str:
    words = T.INTENSITY_INTENSIFIERS if with_int else T.INTENSIFIERS
    wl = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"
    gk = "slot, emotion" + (", intensity" if with_int else "")
    return U + f""", u AS (SELECT * FROM utterances WHERE domain = 'target'),
sd AS ({_slot_sql(with_int)}),
sz AS (SELECT {gk} FROM sd GROUP BY ALL HAVING count(*) >= 10),
d AS (SELECT sd.* FROM sd JOIN sz USING ({gk})),
atk AS (SELECT {gk}, utt_id, {_ASCII_TERMS} AS tk FROM d)""" + tfidf_sql("atk", gk, "utt_id", "tk", 100) + f""",
rs AS (SELECT * FROM sc WHERE list_contains({wl}, term)),
top AS (SELECT *, row_number() OVER (PARTITION BY {gk} ORDER BY score DESC, term) AS r FROM rs),
kw AS (SELECT {gk}, list(term ORDER BY r) AS keywords FROM top WHERE r <= 10 GROUP BY ALL)
"""


Q["t7_intensifiers"] = lambda spark, sf: T.intensifiers(_target(spark, sf)).select(
    "emotion", F.array_join("intensifiers", "|").alias("intensifiers"))
O["t7_intensifiers"] = _intens_sql(False) + """, b AS (SELECT emotion, term, max(score) AS score FROM top WHERE r <= 10 GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY score DESC, term) AS rn FROM b)
SELECT emotion, string_agg(term, '|' ORDER BY rn) AS intensifiers FROM g WHERE rn <= 10 GROUP BY emotion"""

Q["t8_intensity_intensifiers"] = lambda spark, sf: T.intensifiers(_target(spark, sf), by_intensity=True).select(
    "emotion", "intensity", F.array_join("intensifiers", "|").alias("intensifiers"))
O["t8_intensity_intensifiers"] = _intens_sql(True) + """, r AS (SELECT *, row_number() OVER (PARTITION BY emotion,
  CAST(trunc(intensity) AS INTEGER) ORDER BY slot DESC, intensity DESC) AS rn FROM kw)
SELECT emotion, CAST(trunc(intensity) AS INTEGER) AS intensity, array_to_string(keywords, '|') AS intensifiers FROM r WHERE rn = 1"""

# ---------------------------------------------------------------- T9
def _examples(spark, sf):
    u = _target(spark, sf)
    recs = T.style_records(u)
    keys = T.style_groups(recs).select("emotion", "intensity", "sentiment")
    return T.examples(u, keys, k=3, seed=7).drop("__rank_draw")


Q["t9_examples"] = _examples
O["t9_examples"] = REC + f""", m AS (SELECT r.emotion, r.intensity, r.sentiment, r.slot, r.utt_id, r.text,
  row_number() OVER (PARTITION BY r.emotion, r.intensity, r.sentiment
    ORDER BY {draw_long_sql(7, "CAST(r.utt_id AS VARCHAR) || '#' || CAST(r.slot AS VARCHAR)", 'example')},
    CAST(r.utt_id AS VARCHAR) || '#' || CAST(r.slot AS VARCHAR)) AS rn
  FROM rec r JOIN grp g USING (emotion, intensity, sentiment))
SELECT emotion, intensity, sentiment, slot, utt_id, text FROM m WHERE rn <= 3"""

# ---------------------------------------------------------------- T10 / T11
Q["t10_pattern_report"] = lambda spark, sf: T.pattern_report(T.style_patterns(_target(spark, sf)))
O["t10_pattern_report"] = KW + f""", st0 AS (SELECT {K}, utt_id, slot, u.spos, u.s FROM docs,
  LATERAL (SELECT unnest(string_split_regex(text, '[.!?]+')) AS s, unnest(range(0, len(string_split_regex(text, '[.!?]+')))) AS spos) u),
st1 AS (SELECT {K}, utt_id, slot, spos, {_FIRST} AS starter FROM st0),
st2 AS (SELECT {K}, starter, count(*) AS cnt, min((utt_id, slot, spos)) AS seen FROM st1 WHERE starter IS NOT NULL AND starter <> ''
  GROUP BY ALL),
st3 AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY cnt DESC, seen) AS rn FROM st2),
sts AS (SELECT {K}, list(starter ORDER BY rn) AS starters FROM st3 WHERE rn <= 15 GROUP BY ALL),
pr AS (SELECT {K}, count(*) AS sample_count, avg({S.word_count('text')}) AS avg_length,
 avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END) AS qr, avg(CASE WHEN contains(text, '!') THEN 1.0 ELSE 0.0 END) AS er
 FROM docs GROUP BY ALL)
SELECT pr.emotion, pr.intensity_key AS intensity, pr.sentiment, sample_count, round_even(avg_length, 2) AS avg_length,
 CAST(len(coalesce(keywords, [])) AS INTEGER) AS num_keywords, array_to_string(coalesce(keywords, [])[1:5], ', ') AS top_5_keywords,
 array_to_string(coalesce(starters, [])[1:3], ', ') AS top_3_starters, round_even(qr, 3) AS question_ratio, round_even(er, 3) AS exclamation_ratio
FROM pr LEFT JOIN kw USING ({K}) LEFT JOIN sts USING ({K})"""


def _diag(spark, sf):
    u = _target(spark, sf)
    return T.pattern_diagnostics(T.style_patterns(u), T.intensifiers(u), T.intensifiers(u, by_intensity=True))


Q["t11_pattern_diagnostics"] = _diag
O["t11_pattern_diagnostics"] = (
    f"SELECT (SELECT count(*) FROM ({O['t1_style_groups']})) AS patterns, "
    f"(SELECT count(*) FROM ({O['t1_style_groups']})) - (SELECT count(*) FROM ({O['t6_tfidf_keywords']})) "
    f"AS patterns_without_keywords, (SELECT count(*) FROM ({O['t7_intensifiers']})) AS emotion_only_keys, "
    f"(SELECT count(*) FROM ({O['t8_intensity_intensifiers']})) AS intensity_aware_keys")

"""DuckDB text of the style-pattern tables (T1-T9) for an arbitrary target
predicate, with prefixed CTE names so that several can live in one query
(used by the oracle of the pattern attachment, D6)."""

from __future__ import annotations

from affect.functions.clean import WS_CLASS
from affect.operators import labels as L
from affect.operators import text as T
from affect.operators.sampling import draw_long_sql
from affect.plans import sqltext as S
from affect.plans.q_text import SW, tfidf_sql

K = "emotion, intensity_key, sentiment"
_FIRST = f"lower(string_split_regex(regexp_replace(s, '^{WS_CLASS}+', ''), '{WS_CLASS}+')[1])"


def style_ctes(where: str, p: str = "p_") -> str:
    """-> {p}pat(emotion, intensity_key, sentiment, keywords, starters, avg_length)
    and {p}rec (records of the target)."""
    recs = " UNION ALL ".join(
        f"SELECT utt_id, coalesce(utterance, 'nan') AS text, lower({S.strip('sentiment')}) AS sentiment, {k + 1} AS slot, "
        f"{S.lenient(e)} AS emotion, {S.to_num(i)} AS intensity FROM {p}u" for k, (e, i) in enumerate(L.SLOTS))
    words = f"list_filter(regexp_extract_all(lower(text), '{T.WORD_TOKEN}'), lambda t: NOT list_contains({SW}, t))"
    return f""",
{p}u AS (SELECT * FROM utterances WHERE {where}),
{p}rec AS (SELECT * FROM ({recs}) WHERE emotion IS NOT NULL AND intensity IS NOT NULL AND sentiment IS NOT NULL),
{p}g0 AS (SELECT emotion, intensity, sentiment, count(*) AS n FROM {p}rec GROUP BY ALL HAVING count(*) >= 5),
{p}grp AS (SELECT emotion, intensity_key, sentiment, intensity FROM (SELECT *, CAST(trunc(intensity) AS INTEGER) AS intensity_key,
  row_number() OVER (PARTITION BY emotion, CAST(trunc(intensity) AS INTEGER), sentiment ORDER BY intensity DESC) AS rn FROM {p}g0) WHERE rn = 1),
{p}docs AS (SELECT r.*, g.intensity_key FROM {p}rec r JOIN {p}grp g USING (emotion, intensity, sentiment)),
{p}tk AS (SELECT {K}, utt_id, slot, {words} AS tk FROM {p}docs)""" + tfidf_sql(
        f"{p}tk", K, "utt_id, slot", "tk || list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])",
        50, prefix=f"{p}k_") + f""",
{p}top AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score DESC, term) AS r FROM {p}k_sc),
{p}kw AS (SELECT {K}, list(term ORDER BY r DESC) AS keywords FROM {p}top WHERE r <= 20 GROUP BY ALL),
{p}st0 AS (SELECT {K}, utt_id, slot, u.spos, u.s FROM {p}docs,
  LATERAL (SELECT unnest(string_split_regex(text, '[.!?]+')) AS s, unnest(range(0, len(string_split_regex(text, '[.!?]+')))) AS spos) u),
{p}st1 AS (SELECT {K}, utt_id, slot, spos, {_FIRST} AS starter FROM {p}st0),
{p}st2 AS (SELECT {K}, starter, count(*) AS cnt, min((utt_id, slot, spos)) AS seen FROM {p}st1
  WHERE starter IS NOT NULL AND starter <> '' GROUP BY ALL),
{p}st3 AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY cnt DESC, seen) AS rn FROM {p}st2),
{p}sts AS (SELECT {K}, list(starter ORDER BY rn) AS starters FROM {p}st3 WHERE rn <= 15 GROUP BY ALL),
{p}pr AS (SELECT {K}, avg({S.word_count('text')}) AS avg_length FROM {p}docs GROUP BY ALL),
{p}pat AS (SELECT {K}, coalesce(keywords, []) AS keywords, coalesce(starters, []) AS starters, avg_length
  FROM {p}pr LEFT JOIN {p}kw USING ({K}) LEFT JOIN {p}sts USING ({K}))"""


def intensifier_ctes(where: str, with_int: bool, p: str) -> str:
    """-> {p}out(emotion[, intensity], intensifiers) as T7 / T8."""
    words = T.INTENSITY_INTENSIFIERS if with_int else T.INTENSIFIERS
    wl = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"
    gk = "slot, emotion" + (", intensity" if with_int else "")
    parts = []
    for k, (e, i) in enumerate(L.SLOTS):
        cols = f"{k + 1} AS slot, lower({S.strip(e)}) AS emotion, utt_id, coalesce(utterance, 'nan') AS text"
        if with_int:
            cols += f", {S.to_num(i)} AS intensity"
        parts.append(f"SELECT {cols} FROM {p}u")
    cond = "emotion IS NOT NULL AND emotion <> ''" + (" AND intensity IS NOT NULL" if with_int else "")
    ascii_terms = f"list_filter(regexp_extract_all(lower(text), '{T.WORD_RUN}'), lambda t: regexp_full_match(t, '[a-zA-Z]+'))"
    out = f""",
{p}u AS (SELECT * FROM utterances WHERE {where}),
{p}sd AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {cond}),
{p}sz AS (SELECT {gk} FROM {p}sd GROUP BY ALL HAVING count(*) >= 10),
{p}d AS (SELECT {p}sd.* FROM {p}sd JOIN {p}sz USING ({gk})),
{p}atk AS (SELECT {gk}, utt_id, {ascii_terms} AS tk FROM {p}d)""" + tfidf_sql(f"{p}atk", gk, "utt_id", "tk", 100,
                                                                              prefix=f"{p}k_") + f""",
{p}rs AS (SELECT * FROM {p}k_sc WHERE list_contains({wl}, term)),
{p}top AS (SELECT *, row_number() OVER (PARTITION BY {gk} ORDER BY score DESC, term) AS r FROM {p}rs),
{p}kw AS (SELECT {gk}, list(term ORDER BY r) AS keywords FROM {p}top WHERE r <= 10 GROUP BY ALL)"""
    if with_int:
        out += f""",
{p}r AS (SELECT *, row_number() OVER (PARTITION BY emotion, CAST(trunc(intensity) AS INTEGER)
  ORDER BY slot DESC, intensity DESC) AS rn FROM {p}kw),
{p}out AS (SELECT emotion, CAST(trunc(intensity) AS INTEGER) AS intensity, keywords AS intensifiers FROM {p}r WHERE rn = 1)"""
    else:
        out += f""",
{p}b AS (SELECT emotion, term, max(score) AS score FROM {p}top WHERE r <= 10 GROUP BY ALL),
{p}g AS (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY score DESC, term) AS rn FROM {p}b),
{p}out AS (SELECT emotion, list(term ORDER BY rn) AS intensifiers FROM {p}g WHERE rn <= 10 GROUP BY emotion)"""
    return out


def example_ctes(rec: str, k: int, seed: int, p: str) -> str:
    """-> {p}out(emotion, intensity (int), sentiment, texts): k texts per key
    present in the target records, ordered by draw."""
    rid = "CAST(r.utt_id AS VARCHAR) || '#' || CAST(r.slot AS VARCHAR)"
    return f""",
{p}m AS (SELECT r.emotion, r.intensity, r.sentiment, r.text, {draw_long_sql(seed, rid, 'example')} AS dr, {rid} AS rid FROM {rec} r),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY emotion, intensity, sentiment ORDER BY dr, rid) AS rn FROM {p}m),
{p}out AS (SELECT emotion, CAST(trunc(intensity) AS INTEGER) AS intensity, sentiment, list(text ORDER BY dr, text) AS texts
  FROM {p}r WHERE rn <= {k} GROUP BY emotion, intensity, sentiment)"""

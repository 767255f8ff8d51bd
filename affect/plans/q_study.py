"""Registered experiment-statistics queries (X1-X18) over ``results``."""

from __future__ import annotations

from pyspark.sql import functions as F

from affect.functions.stats import f_sf_sql, norm_ppf_sql, norm_sf_sql, poly_sql
from affect.operators import study as X
from affect.sources.fixtures import cte, view

Q: dict = {}
O: dict = {}
R = cte("results")
ENCODERS = ["bert", "distilbert", "roberta"]


def _res(spark, sf):
    return view(spark, "results", sf)


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _agg(spark, sf):
    return X.aggregate_metrics(_res(spark, sf))


AGG = R + """, agg AS (SELECT architecture, encoder, sum(f1_score * support) / sum(support) AS weighted_f1,
 avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1_score) AS mean_f1,
 stddev_samp(f1_score) AS std_f1, CAST(sum(support) AS BIGINT) AS total_support FROM results GROUP BY ALL)
"""

Q["x1_aggregate_metrics"] = lambda spark, sf: _r6(_agg(spark, sf))
O["x1_aggregate_metrics"] = AGG + """SELECT architecture, encoder, round(weighted_f1, 6) AS weighted_f1,
 round(mean_precision, 6) AS mean_precision, round(mean_recall, 6) AS mean_recall, round(mean_f1, 6) AS mean_f1,
 round(std_f1, 6) AS std_f1, total_support FROM agg ORDER BY weighted_f1 DESC"""

_M = ["precision", "recall", "f1_score"]
Q["x2_correlation_matrix"] = lambda spark, sf: _r6(X.correlation_matrix(_res(spark, sf)))
O["x2_correlation_matrix"] = R + "SELECT * FROM (" + " UNION ALL ".join(
    (f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, 1.0::DOUBLE AS corr" if a == b else
     f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 6) AS corr FROM results")
    for a in _M for b in _M) + ")"


Q["x2_correlation_wide"] = lambda spark, sf: _r6(X.correlation_wide(X.correlation_matrix(_res(spark, sf))))
O["x2_correlation_wide"] = R + " UNION ALL ".join(
    f"SELECT '{a}' AS metric, " + ", ".join("1.0::DOUBLE AS " + b if a == b else f"round(corr({a}, {b}), 6) AS {b}" for b in _M) + " FROM results" for a in _M)


def _stats_sql(src: str, by: str, x: str) -> str:
    return f"SELECT {by}, count({x}) AS n, avg({x}) AS mean, var_samp({x}) AS var, var_pop({x}) AS var_pop FROM {src} GROUP BY {by}"


def _anova_sql(stats: str) -> str:
    return f"""
an0 AS (SELECT sum(n * pow(mean - g, 2)) AS ssb, sum((n - 1) * coalesce(var, 0.0)) AS ssw, sum(n) AS nt, count(*) AS k
  FROM (SELECT *, sum(n * mean) OVER () / sum(n) OVER () AS g FROM {stats})),
an AS (SELECT (ssb / (k - 1)) / (ssw / (nt - k)) AS f, CAST(k - 1 AS DOUBLE) AS d1, CAST(nt - k AS DOUBLE) AS d2 FROM an0)
"""


for _by in ["architecture", "encoder"]:
    Q[f"x5_anova_{_by}"] = (lambda b: lambda spark, sf: _r6(X.anova(_res(spark, sf), b)))(_by)
    O[f"x5_anova_{_by}"] = R + f", st AS ({_stats_sql('results', _by, 'f1_score')}),\n" + _anova_sql("st") + \
        f"""SELECT round(f, 6) AS f_statistic, CAST(d1 AS BIGINT) AS df_between, CAST(d2 AS BIGINT) AS df_within,
 round({f_sf_sql('f', 'd1', 'd2')}, 6) AS p_value, {f_sf_sql('f', 'd1', 'd2')} < 0.05 AS significant FROM an"""

    Q[f"x4_levene_{_by}"] = (lambda b: lambda spark, sf: _r6(X.levene(_res(spark, sf), b)))(_by)
    O[f"x4_levene_{_by}"] = R + f""", med AS (SELECT {_by}, quantile_cont(f1_score, 0.5) AS m FROM results GROUP BY 1),
z AS (SELECT r.{_by}, abs(r.f1_score - med.m) AS z FROM results r JOIN med USING ({_by})),
st AS ({_stats_sql('z', _by, 'z')}),""" + _anova_sql("st") + \
        f"""SELECT round(f, 6) AS statistic, CAST(d1 AS BIGINT) AS df_between, CAST(d2 AS BIGINT) AS df_within,
 round({f_sf_sql('f', 'd1', 'd2')}, 6) AS p_value, {f_sf_sql('f', 'd1', 'd2')} > 0.05 AS homogeneous FROM an"""

    Q[f"x6_pairwise_t_{_by}"] = (lambda b: lambda spark, sf: _r6(X.pairwise_t(_res(spark, sf), b)))(_by)
    O[f"x6_pairwise_t_{_by}"] = R + f""", st AS ({_stats_sql('results', _by, 'f1_score')}),
pr AS (SELECT a.{_by} AS group_1, b.{_by} AS group_2, a.mean AS mean_1, b.mean AS mean_2, a.mean - b.mean AS diff,
  (a.mean - b.mean) / sqrt((((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) * (1.0 / a.n + 1.0 / b.n)) AS t,
  CAST(a.n + b.n - 2 AS DOUBLE) AS d2, 1.0::DOUBLE AS d1,
  CASE WHEN sqrt((a.var_pop + b.var_pop) / 2) > 0 THEN (a.mean - b.mean) / sqrt((a.var_pop + b.var_pop) / 2) ELSE 0.0 END AS d
  FROM st a JOIN st b ON a.{_by} < b.{_by}),
pv AS (SELECT *, t * t AS f FROM pr)
SELECT group_1, group_2, round(mean_1, 6) AS mean_1, round(mean_2, 6) AS mean_2, round(diff, 6) AS diff,
 round(t, 6) AS t_statistic, CAST(d2 AS BIGINT) AS dof, round(d, 6) AS cohens_d,
 round({f_sf_sql('f', 'd1', 'd2')}, 6) AS p_value,
 {f_sf_sql('f', 'd1', 'd2')} < 0.05 / count(*) OVER () AS significant FROM pv"""

    Q[f"x3_normality_{_by}"] = (lambda b: lambda spark, sf: _r6(X.normality(_res(spark, sf), b)))(_by)
    O[f"x3_normality_{_by}"] = R + f""", r AS (SELECT {_by}, {X.METRIC} - avg({X.METRIC}) OVER (PARTITION BY {_by}) AS x, CAST(count(*) OVER (PARTITION BY {_by}) AS DOUBLE) AS n,
  row_number() OVER (PARTITION BY {_by} ORDER BY {X.METRIC}) AS r FROM results WHERE {X.METRIC} IS NOT NULL),
p AS (SELECT *, (r - 0.375) / (n + 0.25) AS p FROM r),
m AS (SELECT *, {norm_ppf_sql('p')} AS m FROM p),
s AS (SELECT {_by}, n, sum(x * x) AS ss, sum(m * m) AS mm, sum(m * x) AS mx, max(x) - min(x) AS d1, max(CASE WHEN r = n - 1 THEN x END) - max(CASE WHEN r = 2 THEN x END) AS d2,
  max(m) AS m1, max(CASE WHEN r = n - 1 THEN m END) AS m2, 1 / sqrt(n) AS u FROM m GROUP BY {_by}, n),
a AS (SELECT *, m1 / sqrt(mm) + {poly_sql('u', X.OUTER)} AS a1, m2 / sqrt(mm) + {poly_sql('u', X.NEXT)} AS a2 FROM s),
w AS (SELECT *, pow((mx - m1 * d1 - m2 * d2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * d1 + a2 * d2, 2) / ss AS w, ln(n) AS l FROM a),
z AS (SELECT *, (ln(1 - w) - {poly_sql('l', X.MEAN)}) / exp({poly_sql('l', X.LOG_SD)}) AS z FROM w),
q AS (SELECT *, {norm_sf_sql('z')} AS pv FROM z)
SELECT {_by}, CAST(n AS BIGINT) AS n, round(w, 6) AS statistic, round(pv, 6) AS p_value, pv > 0.05 AS is_normal FROM q"""

Q["x7_rank_combinations"] = lambda spark, sf: _r6(X.rank_combinations(_agg(spark, sf)))
O["x7_rank_combinations"] = AGG + """, r AS (SELECT *, row_number() OVER (ORDER BY weighted_f1 DESC, architecture, encoder) AS rank,
 count(*) OVER () AS n FROM agg)
SELECT architecture, encoder, round(weighted_f1, 6) AS weighted_f1, round(mean_precision, 6) AS mean_precision,
 round(mean_recall, 6) AS mean_recall, round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, total_support,
 CAST(rank AS INTEGER) AS rank, rank <= 5 AS top, rank > n - 5 AS bottom FROM r WHERE rank <= 5 OR rank > n - 5"""

Q["x8_best_worst"] = lambda spark, sf: _r6(X.best_worst(_agg(spark, sf)))
O["x8_best_worst"] = AGG + """, b AS (SELECT architecture || ' + ' || encoder AS best, weighted_f1 AS best_value FROM agg
   ORDER BY weighted_f1 DESC, architecture DESC, encoder DESC LIMIT 1),
w AS (SELECT architecture || ' + ' || encoder AS worst, weighted_f1 AS worst_value FROM agg
   ORDER BY weighted_f1 ASC, architecture DESC, encoder DESC LIMIT 1)
SELECT best, round(best_value, 6) AS best_value, worst, round(worst_value, 6) AS worst_value,
 round(best_value - worst_value, 6) AS difference, round((best_value - worst_value) / worst_value * 100, 6) AS difference_pct FROM b, w"""

Q["x9_factor_means"] = lambda spark, sf: _r6(X.factor_means(_agg(spark, sf)))
O["x9_factor_means"] = AGG + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {f} AS level, round(avg(weighted_f1), 6) AS mean, round(stddev_samp(weighted_f1), 6) AS std, "
    f"count(*) AS count FROM agg GROUP BY {f}" for f in ["architecture", "encoder"])

Q["x10_with_group_score"] = lambda spark, sf: _r6(X.with_group_score(_res(spark, sf), _agg(spark, sf)))
O["x10_with_group_score"] = AGG + """SELECT r.architecture, r.encoder, r.run_id, r.emotion, round(r.precision, 6) AS precision,
 round(r.recall, 6) AS recall, round(r.f1_score, 6) AS f1_score, r.support, round(a.weighted_f1, 6) AS weighted_f1
FROM results r JOIN agg a USING (architecture, encoder)"""

Q["x11_per_class"] = lambda spark, sf: _r6(X.per_class(_res(spark, sf)))
O["x11_per_class"] = R + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY f1_score DESC, run_id) AS rn
   FROM results) WHERE rn = 1),
s AS (SELECT emotion, avg(f1_score) AS mean_f1, stddev_samp(f1_score) AS std_f1, min(f1_score) AS min_f1, max(f1_score) AS max_f1
   FROM results GROUP BY 1)
SELECT emotion, b.architecture AS best_architecture, b.encoder AS best_encoder, b.run_id AS best_run_id,
 round(b.f1_score, 6) AS best_f1, round(b.precision, 6) AS best_precision, round(b.recall, 6) AS best_recall,
 round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, round(min_f1, 6) AS min_f1, round(max_f1, 6) AS max_f1
FROM s JOIN b USING (emotion)"""

Q["x12_pivot_scores"] = lambda spark, sf: _r6(X.pivot_scores(_agg(spark, sf), ENCODERS))
O["x12_pivot_scores"] = AGG + "SELECT architecture, " + ", ".join(
    f"round(max(CASE WHEN encoder = '{e}' THEN weighted_f1 END), 6) AS {e}" for e in ENCODERS) + \
    " FROM agg GROUP BY architecture"

for _f in ["architecture", "encoder"]:
    Q[f"x13_metric_means_{_f}"] = (lambda f: lambda spark, sf: _r6(X.metric_means(_agg(spark, sf), f)))(_f)
    O[f"x13_metric_means_{_f}"] = AGG + f"""SELECT {_f}, round(avg(mean_precision), 6) AS mean_precision,
 round(avg(mean_recall), 6) AS mean_recall, round(avg(weighted_f1), 6) AS weighted_f1 FROM agg GROUP BY 1"""

Q["x14_class_bands"] = lambda spark, sf: _r6(X.class_bands(_res(spark, sf)))
O["x14_class_bands"] = R + """SELECT emotion, round(avg(f1_score), 6) AS mean_f1, CASE WHEN avg(f1_score) > 0.8 THEN 'high'
 WHEN avg(f1_score) > 0.6 THEN 'medium' ELSE 'low' END AS band FROM results GROUP BY 1"""

Q["x15_histogram"] = lambda spark, sf: _r6(X.histogram(_res(spark, sf)))
O["x15_histogram"] = R + """, rg AS (SELECT architecture, min(f1_score) AS lo, max(f1_score) AS hi FROM results GROUP BY 1),
b AS (SELECT r.architecture, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((f1_score - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin
  FROM results r JOIN rg USING (architecture)),
c AS (SELECT architecture, bin, count(*) AS cnt FROM b GROUP BY ALL),
g AS (SELECT architecture, lo, hi, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM rg)
SELECT g.architecture, g.bin, round(lo + (hi - lo) / 20 * g.bin, 6) AS lower, round(lo + (hi - lo) / 20 * (g.bin + 1), 6) AS upper,
 coalesce(c.cnt, 0) AS count FROM g LEFT JOIN c USING (architecture, bin)"""

for _by in ["architecture", "encoder"]:
    Q[f"x16_box_stats_{_by}"] = (lambda b: lambda spark, sf: _r6(X.box_stats(_res(spark, sf), b)))(_by)
    O[f"x16_box_stats_{_by}"] = R + f""", q AS (SELECT {_by}, quantile_cont(f1_score, 0.25) AS q1, quantile_cont(f1_score, 0.5) AS median,
  quantile_cont(f1_score, 0.75) AS q3 FROM results GROUP BY 1),
qi AS (SELECT *, q3 - q1 AS iqr FROM q),
g AS (SELECT {_by}, min(CASE WHEN f1_score >= q1 - 1.5 * iqr THEN f1_score END) AS whisker_low,
  max(CASE WHEN f1_score <= q3 + 1.5 * iqr THEN f1_score END) AS whisker_high,
  count_if(f1_score < q1 - 1.5 * iqr OR f1_score > q3 + 1.5 * iqr) AS outliers FROM results JOIN qi USING ({_by}) GROUP BY 1)
SELECT {_by}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
 round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, outliers FROM qi JOIN g USING ({_by})"""


def _x17(spark, sf):
    res = _res(spark, sf)
    agg = X.aggregate_metrics(res)
    return _r6(X.conclusions(agg, X.factor_means(agg), X.correlation_matrix(res)))


Q["x17_conclusions"] = _x17
O["x17_conclusions"] = AGG + """, fm AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {f} AS level, avg(weighted_f1) AS mean FROM agg GROUP BY {f}"
    for f in ["architecture", "encoder"]) + """),
bf AS (SELECT factor, level, mean FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY mean DESC, level) AS rn FROM fm) WHERE rn = 1),
rk AS (SELECT 100 + row_number() OVER (ORDER BY weighted_f1 DESC, architecture, encoder) AS pos, architecture || ' + ' || encoder AS value,
  weighted_f1 AS score FROM agg)
SELECT CAST(pos AS INTEGER) AS pos, item, value, round(score, 6) AS score FROM (
 (SELECT 1 AS pos, 'best_combination' AS item, architecture || ' + ' || encoder AS value, weighted_f1 AS score FROM agg
   ORDER BY weighted_f1 DESC, architecture DESC, encoder DESC LIMIT 1)
 UNION ALL (SELECT 2, 'worst_combination', architecture || ' + ' || encoder, weighted_f1 FROM agg
   ORDER BY weighted_f1 ASC, architecture DESC, encoder DESC LIMIT 1)
 UNION ALL SELECT 3, 'difference', NULL, max(weighted_f1) - min(weighted_f1) FROM agg
 UNION ALL SELECT 4, 'best_architecture', level, mean FROM bf WHERE factor = 'architecture'
 UNION ALL SELECT 5, 'best_encoder', level, mean FROM bf WHERE factor = 'encoder'
 UNION ALL SELECT 6, 'corr_precision_recall', NULL, corr(precision, recall) FROM results
 UNION ALL SELECT 7, 'corr_precision_f1_score', NULL, corr(precision, f1_score) FROM results
 UNION ALL SELECT 8, 'corr_recall_f1_score', NULL, corr(recall, f1_score) FROM results
 UNION ALL SELECT pos, 'rank', value, score FROM rk)"""


Q["x12_pivot_open"] = lambda spark, sf: X.pivot_scores(_agg(spark, sf)).select(
    "architecture", F.array_join(F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), ",").alias("scores"))
O["x12_pivot_open"] = AGG + """SELECT architecture, string_agg(encoder || '=' || printf('%.6f', weighted_f1), ',' ORDER BY encoder) AS scores FROM agg GROUP BY architecture"""

#: X18's tables: the query that has the same table of its own, and its columns beside the keys (texts with an exclamation mark).
_TABLES = {
    "aggregate": ("x1_aggregate_metrics", "weighted_f1 mean_precision mean_recall mean_f1 std_f1 total_support"), "correlation": ("x2_correlation_matrix", "corr"),
    "ranking": ("x7_rank_combinations", "weighted_f1 mean_precision mean_recall mean_f1 std_f1 total_support rank top bottom"),
    "best_worst": ("x8_best_worst", "best! best_value worst! worst_value difference difference_pct"), "factors": ("x9_factor_means", "mean std count"),
    "per_class": ("x11_per_class", "best_architecture! best_encoder! best_run_id best_f1 best_precision best_recall mean_f1 std_f1 min_f1 max_f1"),
    "pivot": ("x1_aggregate_metrics", "weighted_f1"), "class_bands": ("x14_class_bands", "mean_f1 band!"), "histogram": ("x15_histogram", "lower upper count"),
    "conclusions": ("x17_conclusions", "value! score"),
}
for _by in X.GROUP:
    _TABLES |= {
        f"normality_{_by}": (f"x3_normality_{_by}", "n statistic p_value is_normal"), f"levene_{_by}": (f"x4_levene_{_by}", "statistic df_between df_within p_value homogeneous"),
        f"anova_{_by}": (f"x5_anova_{_by}", "f_statistic df_between df_within p_value significant"),
        f"pairwise_{_by}": (f"x6_pairwise_t_{_by}", "mean_1 mean_2 diff t_statistic dof cohens_d p_value significant"),
        f"metric_means_{_by}": (f"x13_metric_means_{_by}", "mean_precision mean_recall weighted_f1"),
        f"box_{_by}": (f"x16_box_stats_{_by}", "q1 median q3 iqr whisker_low whisker_high outliers")}


def _melted(name: str) -> str:
    query, columns = _TABLES[name]
    measures = ", ".join(f"{{'metric': '{c.rstrip('!')}', 'value': {'NULL::DOUBLE' if c.endswith('!') else f'CAST({c} AS DOUBLE)'}, 'text': {c.rstrip('!') if c.endswith('!') else 'NULL::VARCHAR'}}}" for c in columns.split())
    key = " || '|' || ".join(["''", *[f"CAST({k} AS VARCHAR)" for k in X.STUDY[name]]])
    return f"SELECT '{name}' AS \"table\", key, m.metric AS metric, round(m.value, 6) AS value, m.text AS text FROM (SELECT {key} AS key, unnest([{measures}]) AS m FROM ({O[query]}))"


Q["x18_run_study"] = lambda spark, sf: _r6(X.study(_res(spark, sf)))
O["x18_run_study"] = " UNION ALL ".join(_melted(t) for t in X.STUDY)

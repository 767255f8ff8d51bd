"""Hand-written edge tables (one per semantic trap) and closed-form checks."""

import math

from pyspark.sql import functions as F

from affect.functions import clean as C
from affect.functions.stats import f_sf, t_two_sided_p
from affect.operators import evaluate as E
from affect.operators import labels as L
from affect.operators import rewrite as RW
from affect.operators import study as X
from affect.operators import balance as B
from affect.operators.balance import balance_plan
from affect.sources import reports as RP


def _one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_label_normalisation(spark):
    vals = [" Joy ", "\tjoy\t", " Joy ", "", "nan", "NEUTRAL", "very sad", "zażenowanie", "joy1", None]
    df = _one(spark, [(i, v) for i, v in enumerate(vals)], "i int, v string")
    out = {r.i: (r.s, r.l) for r in df.select("i", C.normalize_label_strict("v").alias("s"),
                                              C.normalize_label("v").alias("l")).collect()}
    assert out[0] == ("joy", "joy") and out[1] == ("joy", "joy") and out[2] == ("joy", "joy")
    assert out[3] == (None, None)
    assert out[4] == (None, "nan")
    assert out[5] == (None, "neutral")        # strict drops neutral, lenient keeps it
    assert out[6] == (None, "very sad")       # not wholly alphabetic
    assert out[7] == ("zażenowanie", "zażenowanie")
    assert out[8] == (None, "joy1")
    assert out[9] == (None, None)


def test_intensity_coercion(spark):
    vals = ["2", " 3 ", "2.7", "0", "9", "-1", "x", "nan", None, "inf"]
    df = _one(spark, [(i, v) for i, v in enumerate(vals)], "i int, v string")
    r = {x.i: (x.num, x.cls) for x in df.select("i", C.to_num("v").alias("num"),
                                                 C.intensity_class("v").alias("cls")).collect()}
    assert r[0] == (2.0, 1) and r[1] == (3.0, 2) and r[2] == (2.7, 1)
    assert r[3] == (0.0, 0) and r[4] == (9.0, 2) and r[5] == (-1.0, 0)
    assert r[6] == (None, 0) and r[7] == (None, 0) and r[8] == (None, 0)
    assert r[9][1] == 0                        # int(float('inf')) raises -> default


def test_sentiment_and_flags(spark):
    sent = ["negative", "neg", " POS ", "2.0", "-4", "7", "??", None, "neutral", "1"]
    df = _one(spark, [(i, v) for i, v in enumerate(sent)], "i int, v string")
    codes = [r.c for r in df.orderBy("i").select(C.sentiment_code("v").alias("c")).collect()]
    assert codes == [0, 0, 2, 2, 0, 2, 1, 1, 1, 1]
    flags = ["1", "0", "yes", "True", "joy", "2", None, "0.0", "Y"]
    df = _one(spark, [(i, v) for i, v in enumerate(flags)], "i int, v string")
    got = [r.f for r in df.orderBy("i").select(C.to_flag("v", "joy").alias("f")).collect()]
    assert got == [1, 0, 1, 1, 1, 0, 0, 0, 1]
    nums = _one(spark, [(0, 0.5), (1, 2.0), (2, None)], "i int, v double")
    assert [r.f for r in nums.orderBy("i").select(C.to_flag("v", "joy", numeric=True).alias("f")).collect()] == [0, 1, 0]


def test_text_repair(spark):
    df = _one(spark, [(1, "", "long enough"), (2, "abcd", "no"), (3, "  hello  ", None), (4, None, None)],
              "id int, text string, original string")
    out = {r.id: r.text for r in C.repair_text(df, "text").collect()}
    assert out == {1: "long enough", 3: "hello"}


def test_bundles_and_one_hot(spark):
    rows = [(1, "joy", "2", "Joy", "3", None, None),          # same emotion twice: last slot wins
            (2, "fear", None, None, "2", None, None),         # emotion without intensity
            (3, None, None, None, None, None, None),          # all null
            (4, "anger", "1", "fear", "2.9", "sadness", "x")]  # unparsable -> 2 in one-hot
    df = _one(spark, rows, "utt_id int, emotion1 string, intensity1 string, emotion2 string, intensity2 string, "
                           "emotion3 string, intensity3 string").withColumn("utterance", F.lit("t"))
    keys = {r.utt_id: r.bundle_key for r in L.with_bundle_key(df).collect()}
    assert keys == {1: "joy:2|joy:3", 2: "neutral:2", 3: "neutral:2", 4: "anger:1|fear:2"}
    oh = {r.utt_id: r for r in L.one_hot(df, ["anger", "fear", "joy", "sadness"]).collect()}
    assert oh[1]["intensity__joy"] == 3 and oh[1]["emotion__joy"] == 1
    assert oh[2]["emotion__fear"] == 1 and oh[2]["intensity__fear"] == 2
    assert oh[4]["intensity__sadness"] == 2 and oh[4]["intensity__fear"] == 2


def test_anova_ttest_closed_form(spark):
    a, b = [1, 2, 3, 4.5], [2, 3.5, 5, 6]
    df = _one(spark, [("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, f1_score double")
    an = X.anova(df, "g").collect()[0]
    assert abs(an.f_statistic - 1.7007874015748) < 1e-9
    assert abs(an.p_value - 0.239978084816298) < 1e-9
    pt = X.pairwise_t(df, "g").collect()[0]
    assert abs(pt.t_statistic ** 2 - 1.7007874015748) < 1e-9
    assert abs(pt.p_value - 0.239978084816298) < 1e-9
    va, vb = sum((x - 2.625) ** 2 for x in a) / 4, sum((x - 4.125) ** 2 for x in b) / 4
    assert abs(pt.cohens_d - (2.625 - 4.125) / math.sqrt((va + vb) / 2)) < 1e-9


def test_f_tail_values(spark):
    df = _one(spark, [(2.5, 3.0, 40.0), (0.4, 1.0, 6.0), (7.7, 1.0, 6.0)], "f double, a double, b double")
    got = [r.p for r in df.select(f_sf(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert abs(got[0] - 0.0732543520179503) < 1e-9
    t = _one(spark, [(2.0, 10.0)], "t double, d double").select(t_two_sided_p(F.col("t"), F.col("d")).alias("p"))
    assert abs(t.collect()[0].p - 0.07338803477074) < 1e-8


def test_levene_median_centre(spark):
    df = _one(spark, [("a", x) for x in [1.0, 2.0, 3.0, 4.5]] + [("b", x) for x in [2.0, 3.5, 5.0, 6.0]],
              "g string, f1_score double")
    lv = X.levene(df, "g").collect()[0]
    za = [abs(x - 2.5) for x in [1, 2, 3, 4.5]]
    zb = [abs(x - 4.25) for x in [2, 3.5, 5, 6]]
    ma, mb = sum(za) / 4, sum(zb) / 4
    g = (ma + mb) / 2
    ssb = 4 * (ma - g) ** 2 + 4 * (mb - g) ** 2
    ssw = sum((z - ma) ** 2 for z in za) + sum((z - mb) ** 2 for z in zb)
    assert abs(lv.statistic - ssb / (ssw / 6)) < 1e-9


def test_quantiles_with_extreme_values(spark):
    import numpy as np
    import pytest
    from pyspark.sql import functions as F
    vals = [((i * 7919) % 3001) / 3001 - 0.3 for i in range(3000)] + [0.0, 0.0, 1e14, -3e9]
    df = _one(spark, [("g", v) for v in vals], "k string, x double")
    for r in X.exact_quantiles(df, ["k"], "x", [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        assert r.q == pytest.approx(float(np.quantile(vals, r.p)), rel=1e-12)
    # the extreme values put all others into one bin of equal width; by magnitude few are left together
    assert df.groupBy(X.magnitude("x", 1 << 16)).count().agg(F.max("count")).first()[0] < 50


def test_quantiles_where_values_crowd(spark):
    """Crowds within one part in 10^10 beside an outlier, a crowd inside a crowd, equal values: no bin over the bound is ranked."""
    import numpy as np
    from pyspark.sql.window import Window

    from affect.operators import order
    vals = {"a": [0.99 + i * 1e-14 for i in range(5000)] + [1e6], "b": [1.0 + i * 2.0 ** -50 for i in range(3000)] + [1.0 + i * 2.0 ** -25 for i in range(3000)] + [-1e300, 1e300],
            "c": [7.0] * 4000, "d": [3.0], "e": [-0.0, 0.0, 5e-324, -5e-324] * 300}
    df = _one(spark, [(k, v) for k, vs in vals.items() for v in vs] + [("c", None), ("f", None), ("c", float("nan"))], "k string, x double").repartition(5)
    ranked = []
    pick = order._pick

    def watched(rows, located, by):
        ranked.extend(r["c"] for r in located.where("__lo < __hi").select(F.col("__c").alias("c")).collect())
        return pick(rows, located, by)

    order._pick = watched
    try:
        got = {(r.k, r.p): r.q for r in order.exact_quantiles(df, ["k"], "x", [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0], bins=64, ranked=100).collect()}
    finally:
        order._pick = pick
    assert ranked and max(ranked) <= 100
    assert len(got) == 5 * 7
    for (k, p), q in got.items():
        want = float(np.quantile(vals[k], p))
        assert q == want or abs(q - want) <= 1e-15 * abs(want), (k, p)


def plain_shapiro(x):
    """W by its definition, a loop over sorted values."""
    from statistics import NormalDist
    x, n = sorted(x), len(x)
    m = [NormalDist().inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm, u = sum(v * v for v in m), n ** -0.5
    outer = m[-1] / mm ** 0.5 + 0.221157 * u - 0.147981 * u ** 2 - 2.07119 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5
    second = m[-2] / mm ** 0.5 + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5
    if n == 3:
        a = [-0.5 ** 0.5, 0, 0.5 ** 0.5]
    elif n <= 5:
        f = ((mm - 2 * m[-1] ** 2) / (1 - 2 * outer ** 2)) ** 0.5
        a = [-outer, *[v / f for v in m[1:-1]], outer]
    else:
        f = ((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * outer ** 2 - 2 * second ** 2)) ** 0.5
        a = [-outer, -second, *[v / f for v in m[2:-2]], second, outer]
    mean = sum(x) / n
    return sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_shapiro_wilk_against_a_plain_version(spark, monkeypatch):
    """Small groups by the definition, a published example, ties over many chunks of ranks, degenerate groups."""
    import random

    from affect.operators import order
    monkeypatch.setattr(order.ranks, "__defaults__", (7,))
    r = random.Random(3)
    groups = {f"g{n}": [round(r.gauss(0, 1), 2) for _ in range(n)] for n in (3, 4, 5, 6, 8, 11, 12, 30, 500)}
    groups["ties"] = [float(r.randint(0, 3)) for _ in range(400)]
    groups["men"] = [float(v) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)]  # weights of Shapiro and Wilk's first example
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("two", 1.0), ("two", 2.0), ("same", 4.0), ("same", 4.0), ("same", 4.0), ("none", None), ("men", None)]
    df = _one(spark, rows, "g string, f1_score double").repartition(4)
    got = {x.g: x for x in X.normality(df, "g").collect()}
    for k, vs in groups.items():
        assert abs(got[k].statistic - plain_shapiro(vs)) < 1e-9 and got[k].n == len(vs), k
    assert abs(got["men"].statistic - 0.7888) < 1e-3 and abs(got["men"].p_value - 0.0067) < 1e-4 and not got["men"].is_normal
    assert got["two"].statistic is None and not got["two"].is_normal and got["same"].statistic == got["same"].p_value == 1.0 and "none" not in got
    assert all(0 <= got[k].p_value <= 1 for k in groups)


def test_study_cells_merge_to_what_rows_give(spark):
    """Any grouping merged from cells equals the same taken from rows, with nulls, far-off means and a level of one row."""
    import random
    r = random.Random(6)
    rows = [(i, r.choice("ABC"), r.choice("xy"), r.choice("pqr"), 1e6 + r.random() if i % 9 else None, r.random(), 1e6 + r.random() if i % 7 else None, r.randint(1, 9)) for i in range(400)]
    rows.append((400, "D", "z", "s", 1e6, 0.5, 1e6 + 0.5, 3))
    df = _one(spark, rows, "run_id long, architecture string, encoder string, emotion string, precision double, recall double, f1_score double, support long")
    cells = X.moment_cells(df)
    for by in ("architecture", "encoder", "emotion"):
        want = {x[by]: x for x in X.group_stats(df, by, "f1_score").collect()}
        for x in X.merge_moments(cells, [by]).collect():
            w = want[x[by]]
            assert x.n == w.n and abs(x.mean - w.mean) < 1e-8 and abs(x.var_pop - w.var_pop) < 1e-9
            assert (x["var"] is None) == (w.n == 1) and (x["var"] is None or abs(x["var"] - w["var"]) < 1e-9)
    want = {(x.metric_a, x.metric_b): x.corr for x in X.correlation_matrix(df).collect()}
    assert {(x.metric_a, x.metric_b) for x in X.correlation_cells(cells).collect()} == set(want)
    assert all(abs(x.corr - want[x.metric_a, x.metric_b]) < 1e-6 for x in X.correlation_cells(cells).collect())
    a = {(x.architecture, x.encoder): x for x in X.aggregate_metrics(df).collect()}
    for x in X.aggregate_cells(cells).collect():
        w = a[x.architecture, x.encoder]
        assert all((x[c] is None and w[c] is None) or abs(x[c] - w[c]) < 1e-6 for c in w.asDict() if c not in X.GROUP)
    assert X.pivot_scores(X.aggregate_cells(cells)).where("architecture = 'D'").first().scores.keys() == {"z"}


def test_normality_sanity(spark):
    import random
    rnd = random.Random(1)
    vals = [rnd.gauss(0, 1) for _ in range(300)] + [rnd.expovariate(1.0) ** 3 for _ in range(300)]
    df = _one(spark, [(i, "n" if i < 300 else "s", v) for i, v in enumerate(vals)],
              "run_id long, g string, f1_score double")
    r = {x.g: x for x in X.normality(df, "g").collect()}
    assert r["n"].p_value > 0.05 and r["n"].is_normal and r["n"].n == 300
    assert r["n"].statistic > 0.98 > 0.7 > r["s"].statistic and r["s"].p_value < 1e-6 and not r["s"].is_normal


def test_f_tail_meets_its_limit_at_any_size(spark):
    """F = 1 with 3 degrees of freedom: the chi-square limit is 0.391625."""
    from pyspark.sql import functions as F

    from affect.functions.stats import f_sf
    df = spark.range(1)
    for d2 in (6e8, 6e10, 6e12):
        for f, d1, want in ((1.0, 3.0, 0.391625), (4.0, 1.0, 0.045500), (2.5, 4.0, 0.040428), (200.0, 2.0, 0.0)):
            p = df.select(f_sf(F.lit(f), F.lit(d1), F.lit(d2)).alias("p")).first().p
            assert abs(p - want) < 1e-6, (d2, f, d1, p)


def test_balance_cap_is_optional(spark):
    df = spark.createDataFrame([("big", i) for i in range(50)] + [("small", 100 + i) for i in range(3)], "bundle_key string, id long")
    plan = {r.bundle_key: r for r in B.balance_plan(df).collect()}
    assert (plan["small"].needed, plan["small"].full_passes, plan["small"].last_pass) == (47, 15, 2)
    rows = B.expansion_rows(df, B.balance_plan(df), "id")
    assert rows.count() == 47 and rows.select("aug_id").distinct().count() == 47
    assert B.expansion_rows(df, B.balance_plan(df, cap=4), "id").count() == 4


def test_exact_quantiles_match_linear_interpolation(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = _one(spark, [("g", v) for v in vals], "k string, x double")
    q = {r.p: r.q for r in X.exact_quantiles(df, ["k"], "x", [0.25, 0.5, 0.75]).collect()}
    import numpy as np
    for p in (0.25, 0.5, 0.75):
        assert abs(q[p] - float(np.quantile(vals, p))) < 1e-12


def _report_text(name, acc, wavg):
    return (f"\n--- {name} ---\nAccuracy: {acc:.4f}\n\n              precision    recall  f1-score   support\n\n"
            f"     low (1)     0.9194    1.0000    0.9580       776\n  medium (2)     0.0000    0.0000    0.0000        63\n"
            f"    high (3)     0.0000    0.0000    0.0000         5\n\n    accuracy                         {acc:.4f}       844\n"
            f"   macro avg     0.3065    0.3333    0.3193       844\nweighted avg     0.8454    0.9194    {wavg:.4f}       844\n")


def test_weighted_f1_golden(spark):
    gold = [0.8808, 0.7338, 0.4963, 0.9225, 0.8226, 0.8413, 0.7771, 0.8999]
    names = ["ACCEPTANCE", "ANGER", "DISGUST", "FEAR", "JOY", "NEUTRAL", "SADNESS", "SURPRISE"]
    text = "".join(_report_text(n, 0.9, g) for n, g in zip(names, gold))
    df = _one(spark, [(1, text)], "run int, text string")
    parsed = RP.parse_reports(df, "text", ["run"])
    assert [r.f1 for r in parsed.orderBy("pos").collect()] == gold
    assert E.mean_weighted_f1(parsed, ["run"]).collect()[0].mean_weighted_f1 == 0.7968
    w = _one(spark, [(0.9747, 776), (0.6061, 63), (0.0, 5)], "f1_score double, support long")
    assert round(E.weighted_f1(w).collect()[0].weighted_f1, 4) == 0.9414


def test_report_layout_roundtrip(spark):
    long = _one(spark, [("x", 0, 0)] * 776 + [("x", 1, 0)] * 63 + [("x", 2, 0)] * 5,
                "emotion string, y_true int, y_pred int")
    rep = E.classification_report(long, ["emotion"], [0, 1, 2], dict(enumerate(E.INTENSITY_CLASSES)),
                                  keep_order=True)
    text = RP.report_lines(rep, ["emotion"]).collect()[0].report
    assert "weighted avg     0.8454    0.9194    0.8808       844" in text
    assert "    accuracy                         0.9194       844" in text
    assert text.startswith("              precision    recall  f1-score   support\n\n     low (1)")


def test_balance_plan_caps(spark):
    rows = []
    uid = 0
    for label, n in [("joy", 1), ("fear", 2), ("anger", 10), ("sadness", 700)]:
        for _ in range(n):
            rows.append((uid, label, "2"))
            uid += 1
    df = _one(spark, rows, "utt_id int, emotion1 string, intensity1 string")
    df = L.canonical_slots(df)
    for mult, expect in [(1.0, {"joy:2": (700, 699), "fear:2": (700, 698), "anger:2": (700, 690), "sadness:2": (700, 0)}),
                         (0.5, {"joy:2": (350, 349), "anger:2": (350, 340), "sadness:2": (350, 0)})]:
        plan = {r.bundle_key: r for r in balance_plan(df, mult).collect()}
        for k, (target, added) in expect.items():
            assert plan[k].target == target and plan[k].added == added
            assert plan[k].added == plan[k].needed == plan[k].full_passes * plan[k]["count"] + plan[k].last_pass
    capped = {r.bundle_key: r for r in balance_plan(df, 1.0, cap=600).collect()}
    assert capped["joy:2"].needed == 600 and capped["sadness:2"].needed == 0


def test_best_epoch_rules(spark):
    rows = [(1, e, l) for e, l in [(1, 1.0), (2, 0.8), (3, 0.8), (4, 0.9), (5, 0.5)]]   # tie, then stop before 5
    rows += [(2, 1, 0.7)]                                                             # single epoch
    rows += [(3, e, l) for e, l in [(1, 0.9), (2, 0.7), (3, 0.6), (4, 0.65)]]          # no early stop
    df = _one(spark, rows, "run_id int, epoch int, loss double")
    r = {x.run_id: x for x in E.best_epoch(df, patience=2).collect()}
    assert (r[1].best_epoch, r[1].stopped_at, r[1].early_stopped) == (2, 4, True)
    assert (r[2].best_epoch, r[2].stopped_at, r[2].early_stopped) == (1, 1, False)
    assert (r[3].best_epoch, r[3].stopped_at, r[3].early_stopped) == (3, 4, False)


def test_completion_cleaning_edges(spark):
    texts = ["  Note that this is edited. I walked home.  ", '"I walked *sigh* home!!"',
             "[meta] I walked home (intensity 2)", "This version is new\nI walked home  ,  fine",
             "ok", "*a* [b] (intensity 3) I walked home ..."]
    df = _one(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.orderBy("i").select(RW.clean_completion("t").alias("c")).collect()]
    assert got == ["I walked home.", "I walked home!", "I walked home", "I walked home, fine", "ok", "I walked home."]
    v = [r.v for r in df.orderBy("i").select(RW.is_valid_output(F.col("t")).alias("v")).collect()]
    assert v == [False, False, False, True, False, False]


def test_quality_bounds(spark):
    df = _one(spark, [("a b c", "a b c", 3.0), ("a", "x y z w v u t s r q p", 1.0), ("a", "b", 200.0)],
              "o string, t string, tl double")
    q = [r.q for r in df.select(RW.quality_score("o", "t", "tl").alias("q")).collect()]
    assert q[0] == 0.5 and all(0.0 <= x <= 1.0 for x in q)


def test_exact_quantiles_many_values(spark):
    import random
    import numpy as np
    rnd = random.Random(7)
    data = {g: [round(rnd.lognormvariate(0, 1), 2) for _ in range(3000)] for g in ("a", "b", "c")}
    data["d"] = [5.0] * 10
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.p): r.q for r in X.exact_quantiles(df, ["k"], "x", [0.1, 0.25, 0.5, 0.75, 0.99], bins=64).collect()}
    for g, vs in data.items():
        for p in (0.1, 0.25, 0.5, 0.75, 0.99):
            assert abs(got[(g, p)] - float(np.quantile(vs, p))) < 1e-9

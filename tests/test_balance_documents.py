"""Replication by any factor, the request ledger, history documents of any layout, one-aggregate reports."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from affect.operators import balance as B
from affect.operators import evaluate as E
from affect.operators.requests import Ledger
from affect.plans.registry import all_queries
from affect.sources import io as IO
from tests.conftest import SF001


def test_replicate_any_factor_in_bounded_steps(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 26), (5, 27), (6, 28), (7, 100), (8, None)], "id long, n long")
    out = B.replicate(rows, "n", "id", fan=3)
    got = Counter(r.id for r in out.collect())
    assert got == {2: 1, 3: 3, 4: 26, 5: 27, 6: 28, 7: 100}
    assert sorted(r["pass"] for r in out.where("id = 7").collect()) == list(range(1, 101))
    assert B.replicate(rows.where("n = 0"), "n", "id").count() == 0


def test_a_row_needed_three_billion_times_plans_without_overflow(spark):
    """Ranges of the last level are counted, not expanded: no array of more than ``fan`` entries is ever made."""
    rows = spark.createDataFrame([(1, 3_000_000_000)], "id long, n long")
    sizes = []
    explode = B.F.explode

    class Watched:
        def __getattr__(self, name):
            return getattr(F, name)

        @staticmethod
        def explode(column):
            sizes.append(column)
            return explode(column)

    B.F, kept = Watched(), B.F
    try:
        out = B.replicate(rows, "n", "id", fan=1000)
    finally:
        B.F = kept
    assert len(sizes) == 4 and dict(out.dtypes)["pass"] == "bigint"
    # the first two cuts make 3 and 3 * 1000 ranges that cover every pass once
    step, ranges = 10 ** 9, [(1, 3_000_000_000)]
    for _ in range(2):
        ranges = [(a, min(a + step - 1, hi)) for lo, hi in ranges for a in range(lo, hi + 1, step)]
        step //= 1000
    assert len(ranges) == 3000 and sum(b - a + 1 for a, b in ranges) == 3_000_000_000
    plan = spark.createDataFrame([("k", 2_999_999_999, 0)], "bundle_key string, full_passes long, last_pass long")
    keyed = spark.createDataFrame([(1, "k", "t")], "utt_id long, bundle_key string, utterance string")
    assert "pass" in B.expansion_rows(keyed, plan, "utt_id").columns


def test_ledger_asks_once_and_goes_on(spark):
    rows = spark.createDataFrame([("1#1", "a"), ("1#2", "a"), ("2#1", "b"), ("2#1", "b"), ("3#1", None)], "aug_id string, prompt string")
    ledger = Ledger(spark, IO.scratch_path(spark, "ledger"))
    assert ledger.pending().count() == 0 and ledger.attach(rows, "aug_id", "prompt").where("completion is not null").count() == 0
    ledger.ask(rows.limit(2), "aug_id", "prompt")
    ledger.ask(rows, "aug_id", "prompt")
    ledger.ask(rows, "aug_id", "prompt")
    assert ledger.requests().count() == 4  # 2#1 stands twice
    key = {r.request_id: r.prompt_id for r in ledger.requests().collect()}
    said = [("1#1", 1, "first"), ("1#1", 3, "last"), ("1#1", 2, "middle"), ("1#1", 3, "last"), ("1#2", 1, None), ("2#1", 1, "two"), ("9#9", 1, "never asked")]
    ledger.record(spark.createDataFrame([(i, key.get(i, "x"), n, t) for i, n, t in said], "request_id string, prompt_id string, attempt int, completion string"))
    assert sorted(r.request_id for r in ledger.pending().collect()) == ["1#2", "3#1"]
    again = Ledger(spark, ledger.path)  # another start of the job
    got = [(r.aug_id, r.completion) for r in again.attach(rows, "aug_id", "prompt").collect()]
    assert Counter(got) == Counter([("1#1", "last"), ("1#2", None), ("2#1", "two"), ("2#1", "two"), ("3#1", None)])
    # a changed prompt is a request of its own
    changed = rows.withColumn("prompt", F.concat("prompt", F.lit("!")))
    assert again.attach(changed, "aug_id", "prompt").where("completion is not null").count() == 0
    again.ask(changed.where("aug_id = '2#1'"), "aug_id", "prompt")
    assert again.pending().count() == 3


def test_history_documents_of_any_layout(spark, tmp_path):
    """Indented, one-line and broken documents, several a file, in folders that name the run."""
    def epochs(k):
        return [{"loss": i + k / 10, "sent_acc": 0.5, "sent_f1": float("nan"), "em_f1_micro": None, "int_acc": 1} for i in range(3)]

    files = {
        "outputs_run12/training_history.json": json.dumps({"train": epochs(1), "val": epochs(2)[:2]}, indent=2),
        "run_3/history.json": json.dumps({"train": epochs(3), "val": []}, indent=4),
        "lines/all.json": "\n".join(json.dumps({"run_id": r, "train": epochs(r)[:1], "val": epochs(r)[:1]}) for r in (5, 6)) + "\n",
        "both/x.json": "\r\n\r\n" + json.dumps({"run_id": 7, "train": epochs(7)[:1]}, indent=2) + "\r\n" + json.dumps({"run_id": 8, "val": epochs(8)[:1], "other": {"a": [1]}}) + "\n\n",
        "broken_run9/training_history.json": json.dumps({"train": epochs(1), "val": epochs(2)}, indent=2)[:100],
        "run10/best_epoch.json": json.dumps({"epoch": 3, "val_metrics": {"loss": 1}}, indent=2),
        "run11/notes.json": "not json at all", "run13/empty.json": "", "run14/list.json": "[1, 2]",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    root = str(tmp_path)
    h = IO.read_history(spark, root)
    got = Counter((r.run_id, r.split) for r in h.collect())
    assert got == {(12, "train"): 3, (12, "val"): 2, (3, "train"): 3, (5, "train"): 1, (5, "val"): 1, (6, "train"): 1, (6, "val"): 1, (7, "train"): 1, (8, "val"): 1}
    broken = Counter(r.reason for r in IO.broken_history(spark, root).collect())
    assert broken == {"not json": 3, "no train or val": 1}
    assert {r.run_id for r in IO.broken_history(spark, root).collect()} == {9, 10, 11, 14}
    assert IO.read_history(spark, root).where("run_id = 5").first().loss == 0.5


def test_history_run_of_folder(spark):
    root = IO.scratch_path(spark, "folders")
    docs = spark.createDataFrame([(r, [(float(r), 0.1)], [(1.0, 0.2)]) for r in (4, 17)], "run_id int, train array<struct<loss: double, sent_acc: double>>, val array<struct<loss: double, sent_acc: double>>")
    IO.write_documents(docs, root, folder_by="run_id", indent=True)
    got = {(r.run_id, r.split, r.epoch, r.loss) for r in IO.read_history(spark, root).collect()}
    assert got == {(4, "train", 1, 4.0), (4, "val", 1, 1.0), (17, "train", 1, 17.0), (17, "val", 1, 1.0)}


def plain_report(pairs, classes=None):
    labels = classes if classes is not None else sorted({x for p in pairs for x in p})
    out = []
    for c in labels:
        tp = sum(a == b == c for a, b in pairs)
        s, p = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        out.append((str(c), tp / p if p else 0.0, tp / s if s else 0.0, 2 * tp / (s + p) if s + p else 0.0, s))
    n, hits = sum(r[4] for r in out), sum(a == b and a in labels for a, b in pairs)
    out.append(("accuracy", None, None, hits / n if n else 0.0, n))
    k = len(labels)
    out.append(("macro avg", *[sum(r[i] for r in out[:k]) / k for i in (1, 2, 3)], n))
    out.append(("weighted avg", *[sum(r[i] * r[4] for r in out[:k]) / n if n else 0.0 for i in (1, 2, 3)], n))
    return out


@pytest.mark.parametrize("classes", [None, [0, 1, 2, 5]])
def test_report_against_a_plain_version(spark, classes):
    r = random.Random(2)
    pairs = {"a": [(r.randint(0, 2), r.randint(0, 3)) for _ in range(60)], "b": [(1, 1)], "c": [(7, 8), (8, 8)]}
    frame = spark.createDataFrame([(k, *p) for k, ps in pairs.items() for p in ps], "k string, y_true int, y_pred int").repartition(3)
    rows = E.classification_report(frame, ["k"], classes).collect()
    for k, ps in pairs.items():
        got = [(x.label, x.precision, x.recall, x.f1, x.support) for x in rows if x.k == k]
        want = plain_report(ps, classes)
        assert [g[0] for g in got] == [w[0] for w in want]
        for g, w in zip(got, want):
            assert g[4] == w[4] and all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(g[1:4], w[1:4])), (k, g, w)


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name, shuffles, scans", [("m8_metrics", 4, 1), ("m9_sentiment_report", 3, 1), ("m10_emotion_report", 3, 1), ("m11_intensity_report", 3, 1), ("x9_factor_means", 4, 1)])
def test_reports_take_one_scan(spark, name, shuffles, scans):
    from tools.plan_report import summarize
    s = summarize(_final(all_queries()[name](spark, SF001)))
    assert s["shuffles"] <= shuffles and s["scans"] == scans and not s["cartesian"], s


def test_patterns_are_merged_by_their_mined_place(spark):
    """The best of each element come first, whatever their letters; a bundle is composed once; an empty one is (neutral, 2)."""
    from affect.operators import adapt as D
    from affect.operators import labels as L
    from tools.plan_report import summarize
    joy = [f"j{i:02}" for i in range(20)]  # worst first, as mined
    fear = [f"a{i:02}" for i in range(20)]
    pats = spark.createDataFrame([("joy", 2, "positive", joy, ["zz", "aa"], 10.0), ("fear", 1, "positive", fear, ["mm", "zz"], 20.0), ("neutral", 2, "positive", ["n"], ["s"], 5.0)],
                                 "emotion string, intensity int, sentiment string, keywords array<string>, sentence_starters array<string>, avg_length double")
    ei = spark.createDataFrame([("joy", ["very", "so"]), ("fear", ["quite"])], "emotion string, intensifiers array<string>")
    ii = spark.createDataFrame([("fear", 1, ["utterly", "deeply"])], "emotion string, intensity int, intensifiers array<string>")
    ex = spark.createDataFrame([("joy", 2, "positive", ["a text"])], "emotion string, intensity int, sentiment string, texts array<string>")
    rows = [(i, "positive", "Joy", "2", "fear", "1.0", None, None) for i in range(5)] + [(5, "Positive", None, None, None, None, None, None), (6, None, "joy", "2", None, None, None, None)]
    cols = ", ".join(f"{c} string" for p in L.SLOTS for c in p)
    src = spark.createDataFrame(rows, f"utt_id int, sentiment string, {cols}")
    out = D.attach_patterns(src, pats, ei, ii, ex)
    assert summarize(_final(out))["broadcasts"] + _final(out).count("SortMergeJoin") <= 2  # one join with the composed table
    got = {r.utt_id: r for r in out.collect()}
    assert sorted(got) == list(range(7))
    want = [w for i in range(19, -1, -1) for w in (f"a{i:02}", f"j{i:02}")]
    assert all(got[i].keywords == want[:30] for i in range(5))
    assert got[0].sentence_starters == ["mm", "zz", "aa"] and got[0].avg_length == 15.0 and got[0].examples == ["a text"]
    assert got[0].intensifiers == ["utterly", "very", "deeply", "so"]
    assert got[5].keywords == ["n"] and got[5].sentence_starters == ["s"]
    assert got[6].avg_length == 50.0 and got[6].keywords == [] and got[6].intensifiers == ["very", "so"]


def test_tfidf_cut_and_uncut(spark):
    """``max_features`` keeps the most frequent terms; without it every term of enough documents is scored, by a join."""
    from affect.operators import text as T
    r = random.Random(4)
    docs = [[f"t{min(int(r.expovariate(0.15)), 40)}" for _ in range(r.randint(0, 12))] for _ in range(120)]
    frame = spark.createDataFrame([("g", d) for d in docs], "k string, terms array<string>").repartition(3)

    def plain(limit):
        import math
        df, ctf = Counter(t for d in docs for t in set(d)), Counter(t for d in docs for t in d)
        vocab = sorted((t for t in df if df[t] >= 2), key=lambda t: (-ctf[t], t))[:limit]
        idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}
        out = Counter()
        for d in docs:
            v = {t: c * idf[t] for t, c in Counter(d).items() if t in idf}
            norm = sum(x * x for x in v.values()) ** 0.5
            for t, x in v.items():
                out[t] += x / norm / len(docs)
        return out

    for limit in (5, None):
        got = {x.term: x.score for x in T.tfidf_scores(frame, ["k"], max_features=limit).collect()}
        want = plain(limit)
        assert set(got) == set(want) and (limit is None) == (len(want) > 5)
        assert all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_selection_with_repeated_ids_and_nulls(spark):
    """Quotas are met exactly, also where rows share an id, and so the draw."""
    from affect.operators.sampling import draw_long, lowest_by_draw
    rows = [("a", i // 4) for i in range(40)] + [("b", None)] * 3 + [("b", 1)] + [("c", 7)] * 5 + [(None, 1)]
    frame = spark.createDataFrame(rows, "k string, id long").repartition(3)
    for n in (0, 1, 2, 3, 6, 100):
        quota = spark.createDataFrame([("a", n), ("b", n), ("c", n), ("none", n)], "k string, __quota long")
        out = lowest_by_draw(frame, ["k"], quota, draw_long(1, "id", "x"), tie="id")
        assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == {k: min(n, m) for k, m in (("a", 40), ("b", 4), ("c", 5)) if n}
        flagged = lowest_by_draw(frame, ["k"], quota, draw_long(1, "id", "x"), tie="id", flag="taken")
        assert flagged.count() == len(rows) and flagged.where("taken").count() == out.count()


def test_labels_outside_any_list_are_kept(spark):
    from affect.operators import labels as L
    from affect.operators import profile as P
    cols = ", ".join(f"{c} string" for p in L.SLOTS for c in p)
    rows = [(1, "brand new", "2", "joy", "1", "brand new", "3"), (2, None, None, "joy", "x", None, "2"), (3, "nan", "1", None, None, None, None)]
    df = spark.createDataFrame(rows, f"utt_id int, {cols}")
    long = {tuple(r) for r in L.melt_map(L.one_hot_map(df, ["utt_id"]), "utt_id").collect()}
    assert long == {(1, "brand new", 1, 3), (1, "joy", 1, 1), (2, "joy", 1, 2)}
    assert ("brand new", 3, 1) in {(r.emotion, r.intensity, r["count"]) for r in P.emotion_intensity_long(df).collect()}
    with pytest.raises(ValueError):
        L.collect_vocabulary(df, most=1)


def test_count_baseline_beats_the_majority(spark):
    """Held-out rows of a table whose words tell the labels; empty texts get the prior."""
    from affect.operators import baseline as BL
    r = random.Random(1)
    rows = []
    for i in range(600):
        s, j = r.choice([0, 0, 0, 1, 2]), r.random() < 0.2
        words = r.choices(["and", "the", "of"], k=4) + r.choices([f"s{s}a", f"s{s}b"], k=2) + (["joyful"] if j else ["plain"])
        rows.append((i, " ".join(words), s, int(j), 1 + s % 2 if j else 0))
    rows += [(600, "", 0, 0, 0), (601, None, 1, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, sentiment_code int, em__joy int, int__joy int")
    model = BL.fit_counts(df.where("doc_id < 400"), ["joy"])
    got = BL.count_score(model, df.where("doc_id >= 400"), ["joy"], "doc_id").collect()
    assert len(got) == 202
    right = sum(max(range(3), key=lambda c: g.sentiment_logits[c]) == g.sentiment_true for g in got)
    assert right > 0.95 * len(got) > 1.3 * sum(g.sentiment_true == 0 for g in got)
    assert sum((g.emotion_logits[0] >= 0) == bool(g.emotion_true[0]) for g in got) > 0.95 * len(got)
    assert BL.count_score(BL.fit_counts(df.where("false"), ["joy"]), df.where("doc_id = 600"), ["joy"], "doc_id").count() == 1

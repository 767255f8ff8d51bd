"""Spark query == DuckDB oracle on sf0.01 (same convention as the driver:
row count, column names, order-insensitive value hash).  A representative
subset runs here; ``python tools/check_oracle.py`` runs every query."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import digest

SUBSET = ["a3_emotion_pairs", "a11_emotion_intensity_crosstab", "l6_one_hot", "m0_load_labels",
          "m1_stratified_split", "m9_sentiment_report", "m17_best_epoch", "x4_levene_architecture",
          "x6_pairwise_t_encoder", "x16_box_stats_encoder", "t6_tfidf_keywords", "t8_intensity_intensifiers",
          "d4_rare_pair_filter", "d11_gate_completion", "d17_expansion_rows", "s10_parse_reports"]


def test_every_query_has_callable_and_known_oracle():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 14 and df.columns == ["emotion_pair", "count", "percentage"]


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, duck, name):
    from tests.conftest import SF01
    df = queries()[name](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert len(srows) == len(orows)
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]

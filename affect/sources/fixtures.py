"""Adapter views: the supplied test tables re-shaped into the inputs the
operators expect (slot-form corpus, experiment results, predictions, batch
history, dirty one-hot labels, model completions, score tables).

Each view is one SQL text that runs unchanged on Spark 4.1 and DuckDB, with
``{table}`` placeholders for the base tables.  Spark resolves a placeholder
to a direct parquet scan (so pruning and pushdown reach the file), the
DuckDB oracle to the pre-registered view of the same name.  The derivation
is pure integer arithmetic over the keys, so every view grows linearly with
the base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Fixed label spellings of the synthetic corpus (dirty on purpose: case,
# padding, a hyphenated rejected label, a label outside the target domain).
_LABELS = "'Joy|anger|SADNESS|neutral| disgust |fear|surprise|acceptance|no-label|guilt'"

UTTERANCES = f"""
SELECT conv_id*100+turn AS utt_id, conv_id, turn,
 CASE WHEN role='user' THEN 'target' ELSE 'source' END AS domain,
 concat(text,' I am ',split_part('very|really|so|quite|extremely|always|never','|',CAST((conv_id+turn)%7+1 AS INT)),
        CASE WHEN (conv_id+turn)%4=0 THEN ' tired. Are you?' ELSE ' tired!' END) AS utterance,
 CASE WHEN (conv_id*11+turn)%23<>0 THEN split_part('negative|neutral|positive','|',CAST((conv_id+2*turn)%3+1 AS INT)) END AS sentiment,
 split_part({_LABELS},'|',CAST((conv_id*7+turn*3)%10+1 AS INT)) AS emotion1,
 CAST(1+(conv_id*3+turn)%3 AS STRING) AS intensity1,
 CASE WHEN (conv_id+turn)%3=0 THEN split_part({_LABELS},'|',CAST((conv_id*5+turn)%10+1 AS INT)) END AS emotion2,
 CASE WHEN (conv_id+turn)%3=0 THEN CASE WHEN conv_id%13=0 THEN 'n/a' ELSE CAST(1+(conv_id+turn*2)%3 AS STRING) END END AS intensity2,
 CASE WHEN (conv_id+turn)%6=0 THEN split_part({_LABELS},'|',CAST((conv_id+turn*7)%10+1 AS INT)) END AS emotion3,
 CASE WHEN (conv_id+turn)%6=0 THEN CAST(1+(conv_id*2+turn)%3 AS STRING) END AS intensity3
FROM {{conversations}}
"""

RESULTS = """
SELECT l_orderkey*10+l_linenumber AS run_id,
 split_part('hard|soft|adapters|mmoe','|',CAST(l_suppkey%4+1 AS INT)) AS architecture,
 split_part('bert|roberta|distilbert','|',CAST(l_partkey%3+1 AS INT)) AS encoder,
 split_part('negative|neutral|positive','|',CAST(l_orderkey%3+1 AS INT)) AS emotion,
 CAST(0.4+l_discount*4 AS DOUBLE) AS precision, CAST(0.3+l_tax*6 AS DOUBLE) AS recall,
 CAST(0.35+l_discount*2+l_tax*3+(l_suppkey%4)*0.01 AS DOUBLE) AS f1_score, CAST(l_quantity AS BIGINT) AS support
FROM {lineitem}
"""

# Four emotions so that the evaluation operators see a real vocabulary.
_PRED_EMOTIONS = [("joy", 5, 2), ("anger", 7, 3), ("sadness", 4, 5), ("fear", 9, 7)]


def _predictions_sql() -> str:
    cols = []
    for name, mod, off in _PRED_EMOTIONS:
        cols.append(
            f" CAST(CASE WHEN (event_id+{off})%{mod}=0 THEN 1 ELSE 0 END AS INT) AS emotion__{name}_label,\n"
            f" CAST(CASE WHEN (event_id+{off}+user_id%2)%{mod}=0 THEN 1 ELSE 0 END AS INT) AS emotion__{name}_pred,\n"
            f" CAST((event_id+{off})%3+1 AS INT) AS intensity__{name}_label,\n"
            f" CAST((event_id+{off}+user_id%{off})%3+1 AS INT) AS intensity__{name}_pred")
    return ("SELECT event_id,\n"
            " split_part('negative|neutral|positive','|',CAST(event_id%3+1 AS INT)) AS sentiment_label,\n"
            " split_part('negative|neutral|positive','|',CAST((event_id + CASE WHEN user_id%4=0 THEN 1 ELSE 0 END)%3+1 AS INT)) AS sentiment_pred,\n"
            + ",\n".join(cols) + "\nFROM {events}\n")


PREDICTIONS = _predictions_sql()
PRED_EMOTIONS = [e for e, _, _ in _PRED_EMOTIONS]

HISTORY = """
SELECT CAST(o_orderkey%5 AS INT) AS run_id, CAST(o_orderkey%12+1 AS INT) AS epoch,
 CASE WHEN o_custkey%2=0 THEN 'train' ELSE 'val' END AS split,
 o_orderkey AS batch_id, o_totalprice/100000.0 AS loss FROM {orders}
"""

LABELS_RAW = """
SELECT d.doc_id, CASE WHEN d.doc_id%17=0 THEN 'ok' WHEN d.doc_id%19=0 THEN NULL ELSE d.text END AS augmented,
 CASE WHEN d.doc_id%34=0 THEN 'no' ELSE d.text END AS original,
 nullif(split_part('negative|neg| POS |2.0|7|neutral|??|NULL','|',CAST(d.doc_id%8+1 AS INT)),'NULL') AS sentiment,
 nullif(split_part('1|0|yes|True|joy|0|NULL|0.0','|',CAST(d.doc_id%8+1 AS INT)),'NULL') AS emotion__joy,
 split_part('0|1|2|3|9|x|1.0|2.7','|',CAST(d.doc_id%8+1 AS INT)) AS intensity__joy,
 CAST(l.toxic AS STRING) AS emotion__anger, CAST(l.quality+1 AS STRING) AS intensity__anger
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id=l.doc_id
"""

COMPLETIONS = """
SELECT conv_id*100+turn AS utt_id, text AS original,
 CASE (conv_id+turn)%6 WHEN 0 THEN concat('Note that this is edited. ',text) WHEN 1 THEN concat('"',text,' *sigh* ok!!"')
  WHEN 2 THEN concat('[meta] ',text,' (intensity 2)') WHEN 3 THEN concat('This version is new',chr(10),text,'  ,  fine')
  WHEN 4 THEN 'ok' ELSE concat(text,' with painting') END AS completion,
 CAST(5+(conv_id%20) AS DOUBLE) AS target_len
FROM {conversations}
"""

# Score table over the embeddings: logits 1-3 sentiment, 4-18 fifteen emotions,
# 19-63 intensity (15 x 3); one of the 64 dimensions is left over.  Array slicing is dialect specific, hence two texts.
SCORE_EMOTIONS = ["joy", "anger", "sadness", "fear", "disgust", "surprise", "acceptance", "neutral", "trust", "shame", "pride", "relief", "envy", "hope", "guilt"]

SCORES_SPARK = """
SELECT vec_id,
 CAST(label%3 AS INT) AS sentiment_true,
 transform(slice(embedding,1,3), x -> CAST(x AS DOUBLE)) AS sentiment_logits,
 transform(slice(embedding,4,15), x -> CAST(x AS DOUBLE)) AS emotion_logits,
 transform(slice(embedding,19,45), x -> CAST(x AS DOUBLE)) AS intensity_logits,
 transform(sequence(1,15), j -> CAST((label+j)%2 AS INT)) AS emotion_true,
 transform(sequence(1,15), j -> CAST((label+j)%3 AS INT)) AS intensity_true
FROM {embeddings}
"""

SCORES_DUCKDB = """
SELECT vec_id,
 CAST(label%3 AS INT) AS sentiment_true,
 list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS sentiment_logits,
 list_transform(embedding[4:18], lambda x: CAST(x AS DOUBLE)) AS emotion_logits,
 list_transform(embedding[19:63], lambda x: CAST(x AS DOUBLE)) AS intensity_logits,
 list_transform(range(1,16), lambda j: CAST((label+j)%2 AS INT)) AS emotion_true,
 list_transform(range(1,16), lambda j: CAST((label+j)%3 AS INT)) AS intensity_true
FROM {embeddings}
"""

VIEWS = {
    "utterances": UTTERANCES,
    "results": RESULTS,
    "predictions": PREDICTIONS,
    "history": HISTORY,
    "labels_raw": LABELS_RAW,
    "completions": COMPLETIONS,
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def spark_sql(sql: str, sf_dir: str) -> str:
    """Resolve ``{table}`` to a parquet scan under ``sf_dir``."""
    return _PLACEHOLDER.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", sql)


def duckdb_sql(sql: str) -> str:
    """Resolve ``{table}`` to the oracle's pre-registered view."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), sql)


def view(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """One adapter view as a Spark DataFrame."""
    if name == "scores":
        return spark.sql(spark_sql(SCORES_SPARK, sf_dir))
    return spark.sql(spark_sql(VIEWS[name], sf_dir))


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """``WITH`` clause that inlines the named adapter views for DuckDB."""
    parts = []
    for n in names:
        body = SCORES_DUCKDB if n == "scores" else VIEWS[n]
        parts.append(f"{n} AS ({duckdb_sql(body).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"

"""A training corpus from ``documents``: five stages, each by an operator of ``affect.llm``.

A stage is ``(name, function)``; the function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects go (score under ``quality.THRESHOLD``).
2. near_duplicates: of each group of near copies (five-word shingles, Jaccard
   similarity of 0.8 or more; repeated rows and rows that share an id are rows of their
   own) one row stays, that of the smallest id (one without an id only if no other has
   one; of several texts of that id the one of the smallest hash).  Rows without words stay.
3. decontamination: documents that contain a window of a benchmark item go.
4. secrets: spans that look like credentials are replaced in the text, and ``n_chars`` follows.
5. packing: what is left becomes sequences of tokens; a row for each piece.

Nulls, empty texts, repeated rows and extra columns are as the operators say;
extra columns of ``docs`` are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affect.llm import decontaminate, jaccard_join, packing, quality, secrets
from affect.llm.common import fresh, table, written
from affect.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    name = fresh("score", docs)
    return quality.score(docs, model, into=name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, alike = fresh("row_key", docs), fresh("wordless", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text", F.col("text").isNull()))  # a row's id and text
    found = jaccard_join.jaccard_components(keyed.select(key, "text"), doc_id=key).distinct()
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").alias("id")).distinct()
    members = found.select(F.col("doc_id").alias("key"), "component_id", (F.col("n_shingles") == 0).alias(alike)).join(ids, "key")
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))
    kept = members.groupBy("component_id", alike).agg(first["key"].alias(key)).drop("component_id")
    # rows of one key follow each other after the join's shuffle: of those with words the first stays
    copy = fresh("copy", docs)
    rows = keyed.join(kept, key).withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return rows.where(F.col(alike) | (F.col(copy) == 1)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh("contamination", docs)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), into=name)
    return found.where(F.col(f"{name}.n_hit") == 0).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs, secrets.learn(docs))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizer_file()))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("decontamination", decontamination_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]

#: Learned models and components over hashes have no SQL; tests/llm compares the ids and texts that the first four stages keep with plain versions
#: (of the learned models, with the same model), and packing's operator with the tokenizer's own pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

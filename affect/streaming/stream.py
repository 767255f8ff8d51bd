"""The stateless column operators on a streaming source.

The reference has no streaming; its cleaning (N1-N11) and completion
validation (D10-D13) are per-row column functions, so they apply unchanged
to a Structured Streaming DataFrame.  Nothing stateful is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affect.functions.clean import normalize_label, normalize_label_strict, to_num, word_count
from affect.operators.labels import SLOTS
from affect.operators.rewrite import gate_completion, is_valid_output


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def clean_labels(df: DataFrame) -> DataFrame:
    """N1/N2/N3 per slot plus the word count of the text (if present)."""
    out = df
    for k, (e, i) in enumerate(SLOTS):
        if e in df.columns:
            out = out.withColumn(f"label{k + 1}", normalize_label(e)).withColumn(f"strict{k + 1}",
                                                                               normalize_label_strict(e))
        if i in df.columns:
            out = out.withColumn(f"intensity_num{k + 1}", to_num(i))
    if "utterance" in df.columns:
        out = out.withColumn("words", word_count("utterance"))
    return out


def gate_completions(df: DataFrame, completion: str = "completion", original: str = "original") -> DataFrame:
    """D11 + D12 on a stream of model completions."""
    out = df.withColumn("output", gate_completion(completion, original))
    return out.withColumn("augmented", F.when(is_valid_output(F.col("output")), F.col("output"))
                          .otherwise(F.col(original)))


def start_to_memory(df: DataFrame, name: str, checkpoint: str):
    """Append-mode query into an in-memory table (tests, notebooks)."""
    return (df.writeStream.format("memory").queryName(name).outputMode("append")
              .option("checkpointLocation", checkpoint).start())

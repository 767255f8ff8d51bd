from pyspark.sql import functions as F

from affect.sources.io import scratch_path
from affect.streaming import stream as ST
from tests.conftest import SF001


def test_completion_gate_on_stream(spark):
    conv = spark.read.parquet(f"{SF001}/conversations.parquet")
    src = ST.read_stream(spark, f"{SF001}/conversations*.parquet", conv.schema)
    s = src.select((F.col("conv_id") * 100 + F.col("turn")).alias("utt_id"), F.col("text").alias("original"),
                   F.concat(F.lit("Note that: "), F.col("text"), F.lit(" *sigh*")).alias("completion"))
    q = ST.start_to_memory(ST.gate_completions(s), "gated", scratch_path(spark, "stream_ckpt"))
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM gated")
    assert out.count() == conv.count()
    assert out.where(F.col("augmented").contains("*")).count() == 0

"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that
speaker as the assistant and all others as named users; the loss mask covers
what the assistant says (and the end mark that it must learn to give).  The
role ``system`` is an instruction, not a participant.

Dialogues are rendered whole, in segments of ``SEGMENT`` turns, the length of a
training context, so that no row grows with the longest dialogue and one that holds
a third of all rows is dealt to many tasks: every participant of the dialogue
gets a row for every segment.

Cases: turns are ordered by number (turns without one come last), then role, then text; a null role is the
speaker ``unknown``; a null text is empty; a repeated row is a turn like any
other; a very long text stands whole in its segment; other columns are not read; rows without a dialogue id belong to no dialogue and are left out; a
dialogue of system turns only has no participant and no row.  ``<|`` in texts is
written ``< |``, so that no text can give a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from affect.llm.common import written

SEGMENT = 512
START, END, SYSTEM, UNKNOWN = "<|im_start|>", "<|im_end|>", "system", "unknown"


def dialogues(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, speaker, n_messages, n_assistant, rendered, mask``: a row for every
    participant of the dialogue and every segment, whoever speaks in it; ``mask`` are the code
    point spans of ``rendered`` (end exclusive) that count for the loss.

    A segment is ``segment`` turns by their place in the dialogue (turns without
    a number come last), whatever their numbers.  Before the turns of a later segment stand the system turns of the earlier ones, each text once
    (they count in ``n_messages``); leaving those out, a participant's segments
    are the dialogue."""
    message = F.struct("number", F.col("turn").isNull().alias("no_turn"), "turn", "role", "text").alias("m")
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(UNKNOWN)).alias("role"),
                                                          F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    longer = written(rows.groupBy("conv_id").count().where(F.col("count") > segment).select("conv_id"), "longer")
    short = _spoken(rows.join(longer, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("bigint").alias("segment"), F.lit(0).cast("bigint").alias("number"), "turn", "role", "text")
                    .select("conv_id", "segment", message))
    placed = _numbered(rows.join(longer, "conv_id", "left_semi")).withColumn("segment", F.floor(F.col("number") / segment).cast("bigint"))
    placed = written(placed, "turns")
    segments = placed.select("conv_id", "segment").distinct()
    system = placed.where(F.col("role") == SYSTEM).groupBy("conv_id", "text").agg(F.min(F.struct("number", "segment", "turn")).alias("first"))
    system = system.select("conv_id", "first.number", F.col("first.segment").alias("since"), "first.turn", F.lit(SYSTEM).alias("role"), "text")
    carried = segments.join(system, "conv_id").where("since < segment").select("conv_id", "segment", message)
    whole = placed.select("conv_id", "segment", message).union(carried).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    speakers = placed.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    return _rendered(short.unionByName(whole.join(speakers, "conv_id")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``, the place of a turn in its dialogue from 0.  Turns are dealt by ranges, so that
    a dialogue is numbered by many tasks; equal turns may stand in any order."""
    keys = [F.col("conv_id"), F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("tie")).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "dealt")
    before = (dealt.groupBy("conv_id", "part").count()
              .select("conv_id", "part", (F.sum("count").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("count")).alias("before")))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*keys[1:], "tie"))
    return dealt.withColumn("within", within).join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("within") - 1).alias("number"), "turn", "role", "text")


def _spoken(rows: DataFrame) -> DataFrame:
    """Messages by dialogue and segment, a row for each participant that speaks in them."""
    found = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    speakers = F.array_distinct(F.filter(F.transform("messages", lambda m: m["role"]), lambda r: r != SYSTEM))
    return found.select("conv_id", "segment", "messages", F.explode(speakers).alias("speaker"))


def _rendered(each: DataFrame) -> DataFrame:
    def head(m):
        name = F.when(m["role"] == F.col("speaker"), "assistant").when(m["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), m["role"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    parts = F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (m["role"] == F.col("speaker")).alias("own")))
    each = each.select("conv_id", "segment", "speaker", parts.alias("parts"))
    span = "struct<start: int, end: int>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(done, p):
        begin = done["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        spans = F.when(p["own"], F.concat(done["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(done["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return each.select("conv_id", "segment", "speaker", F.size("parts").cast("bigint").alias("n_messages"),
                       F.size(F.filter("parts", lambda p: p["own"])).cast("bigint").alias("n_assistant"),
                       F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
                       F.aggregate("parts", empty, add, lambda done: done["spans"]).alias("mask"))

"""Scans and sinks (survey S1-S7, S9).

CSV corpora are read with an all-string schema (no inference pass over the
data; typing happens afterwards through ``try_cast`` helpers), quoted fields over
several lines (or, where a file has none, split into ranges) and optional malformed-row dropping.  Sinks write one
directory per table; report-style sinks write small one-row frames.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affect.operators.labels import canonical_slots
from affect.operators.prepare import resolve_text_column, strip_columns  # noqa: F401  (S2, S9)
from affect.session import checkpoint_dir

TEXT_KEYS_STYLE = ["utterance", "text", "message", "content"]
TEXT_KEYS_ONE_HOT = ["utterance", "text", "augmented", "message"]


def _csv_header(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    """Column names from the header line only (one small read)."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path).columns


def read_corpus(spark: SparkSession, path: str, fmt: str = "csv", drop_malformed: bool = False,
                schema: T.StructType | None = None, canonical: bool = True, multi_line: bool = True) -> DataFrame:
    """Read a corpus.  CSV: header, multi-line quoted fields, every
    column a string unless ``schema`` is given; ``drop_malformed`` skips rows
    that do not fit the schema; header names are stripped.  ``multi_line=False``
    promises that no field holds a line end, as in tables of codes and labels: a large
    file is then read by many tasks instead of one.  Parquet/JSON are
    read as they are.  With ``canonical`` the slot columns are mapped onto
    ``emotion1..3`` / ``intensity1..3``."""
    if fmt == "csv":
        r = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
                  .option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE"))
        if schema is None:
            cols = _csv_header(spark, path, multi_line)
            schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
        df = r.schema(schema).csv(path)
    elif fmt == "json":
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    df = strip_columns(df)
    return canonical_slots(df) if canonical else df


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> str:
    """Overwrite ``path`` with ``df`` (CSV with header, or parquet/json)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # keep surrounding whitespace of values (the writer trims by default)
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """A key/value or JSON report — small frames only (one file)."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_documents(df: DataFrame, path: str, folder_by: str | None = None, indent: bool = False) -> str:
    """One JSON document a row, by as many tasks as the frame has.  With ``indent`` each
    document is spread over lines; with ``folder_by`` each value of that column gets a
    folder of its own (``<column>=<value>``) and is left out of the document."""
    body = F.struct(*[F.col(c) for c in df.columns if c != folder_by])
    text = F.to_json(body, {"pretty": "true"} if indent else {})
    w = df.select(*([folder_by] if folder_by else []), text.alias("value")).write.mode("overwrite")
    (w.partitionBy(folder_by) if folder_by else w).text(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- S4
HISTORY_SCHEMA = T.StructType([
    T.StructField("run_id", T.IntegerType()),
    T.StructField("train", T.ArrayType(T.StructType([
        T.StructField(m, T.DoubleType()) for m in ("loss", "sent_acc", "sent_f1", "em_f1_micro", "int_acc")]))),
    T.StructField("val", T.ArrayType(T.StructType([
        T.StructField(m, T.DoubleType()) for m in ("loss", "sent_acc", "sent_f1", "em_f1_micro", "int_acc")]))),
])


def history_documents(epochs: DataFrame, keys=("run_id",)) -> DataFrame:
    """Epoch metrics (keys, epoch, split, loss...) -> one nested training
    history document per run ({train: [...], val: [...]}, epoch order)."""
    keys = list(keys)
    metrics = [c for c in epochs.columns if c not in keys + ["epoch", "split", "batches"]]
    rec = F.struct(F.col("epoch"), F.struct(*[F.col(m) for m in metrics]).alias("m"))
    g = epochs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("split") == "train", rec))).alias("__t"),
        F.array_sort(F.collect_list(F.when(F.col("split") == "val", rec))).alias("__v"))
    return g.select(*keys, F.transform("__t", lambda x: x["m"]).alias("train"),
                    F.transform("__v", lambda x: x["m"]).alias("val"))


def scan_documents(spark: SparkSession, path: str, schema: T.StructType, needs: list[str]) -> DataFrame:
    """Every JSON document of the files under ``path`` (folders included): ``path``, ``document``
    (null if broken), ``reason`` and ``text`` of broken ones.

    A document begins at a ``{`` in the first column, so indented documents (one
    or several a file) and one-line ones are read by the same scan, which
    splits large files between documents.  A document that does not parse, or
    has none of the fields ``needs``, is a row with a reason, never lost."""
    bad = "__broken"
    raw = (spark.read.option("lineSep", "\n{").option("recursiveFileLookup", True).text(path)
           .select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^[\\s\\x{FEFF}]+|\\s+$", "").alias("text")))
    raw = raw.where(F.col("text") != "").withColumn("text", F.when(F.substring("text", 1, 1).isin("{", "["), F.col("text")).otherwise(F.concat(F.lit("{"), "text")))
    parsed = raw.withColumn("document", F.from_json("text", T.StructType([*schema.fields, T.StructField(bad, T.StringType())]),
                                                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    some = functools.reduce(lambda x, y: x | y, [F.col(f"document.{c}").isNotNull() for c in needs])
    reason = F.when(F.col("document").isNull() | F.col(f"document.{bad}").isNotNull(), "not json").when(~some, "no " + " or ".join(needs))
    return parsed.select("path", F.when(reason.isNull(), F.col("document").dropFields(bad)).alias("document"), reason.alias("reason"),
                         F.when(reason.isNotNull(), F.col("text")).alias("text"))


def _run_of(path: str) -> Column:
    """The number that the name of the file's folder ends with."""
    return F.regexp_extract(path, "(\\d+)[^/0-9]*/[^/]*$", 1).try_cast("int")


def read_history(spark: SparkSession, path: str, schema: T.StructType = HISTORY_SCHEMA) -> DataFrame:
    """Training-history documents -> long (run_id, split, epoch, metric...)
    with epochs numbered 1..n in document order.  A document without a run id of its
    own has that of its folder's name; broken ones are left to :func:`broken_history`."""
    docs = scan_documents(spark, path, schema, ["train", "val"]).where("reason is null")
    docs = docs.select(F.coalesce("document.run_id", _run_of("path")).alias("run_id"), "document.train", "document.val")
    sides = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("epochs")) for s in ("train", "val")])
    return (docs.select("run_id", F.inline(sides)).select("run_id", "split", F.posexplode("epochs").alias("pos", "m"))
            .select("run_id", "split", (F.col("pos") + 1).alias("epoch"), "m.*"))


def broken_history(spark: SparkSession, path: str, schema: T.StructType = HISTORY_SCHEMA) -> DataFrame:
    """The documents under ``path`` that :func:`read_history` cannot use: run (by folder), path, reason, text."""
    broken = scan_documents(spark, path, schema, ["train", "val"]).where("reason is not null")
    return broken.select(_run_of("path").alias("run_id"), "path", "reason", "text")


# ---------------------------------------------------------------- S7
def latest_report(reports: DataFrame, ts_col: str = "report_ts") -> DataFrame:
    """Rows of the newest report (lexicographically last ``ts_col``).
    On a dataset partitioned by ``ts_col`` the filter prunes partitions."""
    newest = reports.agg(F.max(ts_col).alias("__ts"))
    return reports.join(F.broadcast(newest), F.col(ts_col) == F.col("__ts"), "left_semi")

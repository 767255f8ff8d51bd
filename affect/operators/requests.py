"""Requests to a language model and their answers, as tables (survey D18 with completions).

The model is called outside.  What is asked and what came back are two tables in a
shared folder, to which rows are only ever added:

``requests``  request_id, prompt_id, prompt
``answers``   request_id, prompt_id, attempt, completion

A request is a row and a pass (``aug_id``), its prompt is told by a hash, so a prompt
that changes is a new request.  Asking again adds only what was not asked before;
what has no answer is pending; of several answers the last attempt counts.  A job that
stops at any point is started again and goes on from what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUESTS = T.StructType([T.StructField(c, T.StringType()) for c in ("request_id", "prompt_id", "prompt")])
ANSWERS = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("prompt_id", T.StringType()),
                        T.StructField("attempt", T.IntegerType()), T.StructField("completion", T.StringType())])
KEY = ["request_id", "prompt_id"]


class Ledger:
    """The two tables under ``path`` (made when first written)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("requests", REQUESTS), ("answers", ANSWERS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def requests(self) -> DataFrame:
        return self._table("requests", REQUESTS)

    @staticmethod
    def keyed(rows: DataFrame, id_col: str, prompt: str) -> DataFrame:
        """``rows`` with the key of their request."""
        return rows.withColumn("request_id", F.col(id_col).cast("string")).withColumn("prompt_id", F.sha2(F.coalesce(prompt, F.lit("")), 256))

    def ask(self, rows: DataFrame, id_col: str, prompt: str) -> None:
        """Adds a request for every row that was not asked before (one for rows that repeat)."""
        new = self.keyed(rows.select(id_col, F.col(prompt).alias("prompt")), id_col, "prompt").select(*KEY, "prompt")
        new.dropDuplicates(KEY).join(self.requests().select(*KEY), KEY, "left_anti").write.mode("append").parquet(f"{self.path}/requests")

    def record(self, answers: DataFrame) -> None:
        """Adds answers (the columns of ``answers``); any number of attempts, in any order, also repeated ones."""
        answers.select(*[F.col(f.name).cast(f.dataType) for f in ANSWERS.fields]).write.mode("append").parquet(f"{self.path}/answers")

    def answers(self) -> DataFrame:
        """One row for each answered request: the completion of the last attempt that has one (of equal attempts the greatest text)."""
        a = self._table("answers", ANSWERS).where("completion is not null")
        return a.groupBy(*KEY).agg(F.max(F.struct("attempt", "completion"))["completion"].alias("completion"))

    def pending(self) -> DataFrame:
        """Requests without an answer."""
        return self.requests().dropDuplicates(KEY).join(self.answers().select(*KEY), KEY, "left_anti")

    def attach(self, rows: DataFrame, id_col: str, prompt: str, into: str = "completion") -> DataFrame:
        """``rows`` with the answer to their request in ``into``, null while it is pending."""
        return self.keyed(rows, id_col, prompt).join(self.answers().withColumnRenamed("completion", into), KEY, "left").drop(*KEY)

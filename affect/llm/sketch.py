"""Document fingerprints: bottom-k sketches of shingle hashes, in SQL functions only.

A sketch is the sorted array of the ``size`` smallest 64-bit hashes of a text's
distinct shingles (five words, lower-cased).  Sketches merge (the smallest of
the union), and estimate resemblance, containment and the number of distinct
shingles; sets of at most ``size`` shingles are told exactly.

Cases: a null or empty text has the empty sketch, of which the fingerprint is
the empty string; a text of fewer than five words is one shingle; two empty
sketches resemble each other by 1, an empty and another one by 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 128
SHINGLE = 5
#: Rows of a bucket of neighbouring ids, and buckets at most (their edges are broadcast: 16 bytes each).
BUCKET, BUCKETS = 2000, 1_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: str | Column, size: int = SIZE, k: int = SHINGLE) -> Column:
    """Sketch of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, size))

    return _let(words, of)


def merge(a: str | Column, b: str | Column, size: int = SIZE) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(_col(a), _col(b))), 1, size)


def resemblance(a: str | Column, b: str | Column, size: int = SIZE) -> Column:
    """Estimate of the Jaccard similarity: how much of the union's sketch is in both."""
    return _let(merge(a, b, size), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(_col(a), _col(b)), u)) / F.size(u)))


def distinct_count(a: str | Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles: of the ``size`` smallest hashes, how far the last reaches."""
    c = _col(a)
    reach = (F.element_at(c, -1).cast("double") + F.lit(2.0 ** 63) + 1.0) / F.lit(2.0 ** 64)
    return F.when(F.size(c) < size, F.size(c).cast("double")).otherwise((size - 1) / reach)


def containment(a: str | Column, b: str | Column, size: int = SIZE) -> Column:
    """Estimate of the share of the first set that is in the second."""
    both = resemblance(a, b, size) * distinct_count(merge(a, b, size), size)
    return F.when(F.size(_col(a)) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, size)))


def fingerprint(a: str | Column) -> Column:
    """The sketch as text, 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(_col(a), lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge_parts(parts: DataFrame, keys: list[str], sketches: str, size: int = SIZE) -> DataFrame:
    """``keys`` and the merged sketch of all parts that share them.  Every task
    keeps the smallest hashes of what it has before the shuffle."""
    hashes = parts.select(*keys, F.explode(sketches).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    return hashes.withColumn("rank", rank).where(F.col("rank") <= size).groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketches))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", made: dict[str, Column] | None = None, bucket_rows: int = BUCKET) -> DataFrame:
    """``docs`` with ``next_*`` of ``columns`` and of the columns ``made`` from
    them: their values in the row that follows by descending id, and in the
    first row for the last one.

    Ids are cut into buckets; each is ordered by a task of its own, after the
    first row of the next bucket below has been copied into it.  Only edges of
    buckets (``BUCKETS`` at most) are broadcast.  Rows of one id follow one
    another by ``columns``; null ids come last."""
    ids = docs.agg(F.min(doc_id).alias("lo"), F.max(doc_id).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, min(BUCKETS, -(-ids["n"] // bucket_rows)))
    lo = float(ids["lo"] if ids["lo"] is not None else 0)
    width = max(1.0, (float(ids["hi"] if ids["hi"] is not None else 0) - lo + 1) / buckets)
    bucket = F.coalesce(F.floor((F.col(doc_id).cast("double") - lo) / width).cast("int"), F.lit(-1))
    rows = docs.withColumn("_bucket", bucket)
    edges = rows.groupBy("_bucket").agg(F.max(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))).alias("_edge"))
    # the first row of a bucket goes to the bucket above, that of the highest one to the lowest
    above = F.coalesce(F.lead("_bucket").over(Window.orderBy("_bucket")), F.min("_bucket").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edges = edges.select(F.col("_bucket").alias("_from"), "_edge", above.alias("_to"))
    copies = rows.join(F.broadcast(edges), (F.col("_bucket") == F.col("_from")) & (F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")) == F.col("_edge")))
    copies = copies.withColumn("_bucket", F.col("_to")).select(*rows.columns, F.lit(1).alias("_copy"))
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col(doc_id).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns])
    all_rows = rows.withColumn("_copy", F.lit(0)).unionByName(copies)
    all_rows = all_rows.withColumns(made or {})
    for c in [*columns, *(made or {})]:
        all_rows = all_rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return all_rows.where(F.col("_copy") == 0).drop("_copy", "_bucket")


def edited_fingerprints(docs: DataFrame, size: int = SIZE, k: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every text its sketch and that of an edited text (the last third of
    the code points replaced by the beginning of the next text by descending
    id), with the likeness to the edited and to the next text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = with_next(rows, ["text"], made={"sketch": sketch("text", size, k)})
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch("edited", size, k))
    return rows.withColumn("near_edited", resemblance("sketch", "edited_sketch", size)).withColumn("near_next", resemblance("sketch", "next_sketch", size))

"""Ranked lexical search: best-first document intervals over range-maximum tables.

Documents are cut into blocks.  In a block every term of the queries has a
posting list (documents in the block's order, with impacts) and, over the list,
a sparse table that answers "which posting of this range has the greatest
impact" with two look-ups.  A query starts with one interval, the whole block.
The bound of an interval is the sum, over the query's terms, of the greatest
impact inside it.  The intervals of the highest bounds are taken first: each is
split at the document of its greatest single impact, that document is scored,
and the two halves get bounds of their own.  An interval goes when its bound is
under the score of the k-th best document so far; what is left over when none
remains is exact.  A block's documents stand by length, which decides impacts
more than anything else, so that bounds are tight.

Terms are the maximal runs of ``0-9A-Za-z`` and non-ASCII characters, A-Z
lower-cased.  A term weighs ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a
document of n terms has ``m = 10 + (90 n N) div L``; the impact of a term that
occurs tf times is ``w * ((1000000000 tf) div (1000 tf + 8 m))``; a score is the
sum of impacts.  N counts documents with a term, L all their terms.

Scale: queries come in groups of at most ``GROUP_TERMS`` terms, one after another, so that
what is broadcast is bounded; each group reads the texts once and leaves packed
postings of its own terms in the shared folder, searched in a second step.  A task
keeps the best k of each query over its blocks, and these alone are shuffled.

Cases: null and empty texts have no terms and are not counted; a document
without an id counts and can be found, after those of equal score that have one;
repeated rows are documents of their own; rows of queries that share an id (or
have none) are one query, of all their terms; a query without terms, or whose
terms occur nowhere, and empty tables give no rows; other columns are not read."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affect.llm.blobs import pack, unpack
from affect.llm.common import arrow_column, give_back, utf8, written

TOP = 10
#: Terms of the queries of a group, at most (a longer query is a group of its own).
GROUP_TERMS = 200_000
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 600_000
#: Intervals that are split together.
WIDTH = 64
#: Small letters for capitals; a space for every byte that belongs to no term.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCKS = "docs long, terms long, held array<struct<term: int, docs: long>>, block binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def weight(n_docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))


class Block:
    """Posting lists of a block with their sparse tables."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 weights: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((ids, null, n))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.null, self.size = ids[order], null[order], len(order)
        doc = np.repeat(np.arange(len(n)), sizes)
        m = 10 + (90 * n * n_docs) // max(1, n_terms)
        impact = weights[term] * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m[doc]))
        keys = term.astype(np.int64) * self.size + place[doc]
        by_key = np.argsort(keys)
        self.keys, self.impact = keys[by_key], impact[by_key]
        self.lists = np.searchsorted(self.keys, np.arange(len(weights) + 1) * self.size)
        #: ``table[j][i]``: the first greatest posting of the ``2 ** j`` from i on, as far as one list reaches
        longest = int(np.diff(self.lists).max(initial=0))
        rows = [np.arange(len(keys), dtype=np.int32)]
        while 1 << len(rows) <= longest:
            half, row = 1 << (len(rows) - 1), rows[-1]
            there = np.concatenate([row[half:], np.full(min(half, len(row)), max(0, len(row) - 1), np.int32)])
            rows.append(np.where(self.impact[row] >= self.impact[there], row, there))
        self.table = np.concatenate(rows)
        self.log2 = np.zeros(longest + 1, np.int64)
        for j in range(1, len(rows)):
            self.log2[1 << j:] = j

    def greatest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the greatest posting in every ``[a, b)``; impact 0 where there is none."""
        some = b > a
        j = self.log2[np.where(some, b - a, 0)]
        n = len(self.keys)
        x = self.table[j * n + np.where(some, a, 0)]
        y = self.table[j * n + np.where(some, b - (1 << j), 0)]
        vx, vy = self.impact[x], self.impact[y]
        return np.where(vx >= vy, x, y), np.where(some, np.maximum(vx, vy), 0)

    def search(self, terms: np.ndarray, best: list[tuple[int, bool, int]], top: int) -> list[tuple[int, bool, int]]:
        """The ``top`` best of ``best`` and this block's documents, as (-score, id is null, id)."""
        a, b = self.lists[terms], self.lists[terms + 1]
        terms, a, b = terms[b > a], a[b > a], b[b > a]
        if not len(terms):
            return best
        first = terms.astype(np.int64) * self.size
        a, b = a[None, :], b[None, :]
        place, most = self.greatest(a, b)
        bound = most.sum(axis=1)
        while True:
            least = max(1, -best[-1][0]) if len(best) == top else 1
            live = bound >= least
            if not live.all():
                a, b, place, most, bound = a[live], b[live], place[live], most[live], bound[live]
            if not len(bound):
                return best
            if len(bound) > WIDTH:
                taken = np.zeros(len(bound), bool)
                taken[np.argpartition(bound, -WIDTH)[-WIDTH:]] = True
            else:
                taken = np.ones(len(bound), bool)
            ta, tb = a[taken], b[taken]
            # split at the document of the greatest single impact
            widest = most[taken].argmax(axis=1)
            doc = self.keys[place[taken][np.arange(len(ta)), widest]] - first[widest]
            at = np.clip(np.searchsorted(self.keys, first[None, :] + doc[:, None]), ta, tb)
            here = (at < tb) & (self.keys[np.minimum(at, len(self.keys) - 1)] == first[None, :] + doc[:, None])
            scores = np.where(here, self.impact[np.minimum(at, len(self.keys) - 1)], 0).sum(axis=1)
            good = scores >= least
            if good.any():
                d = doc[good]
                found = zip((-scores[good]).tolist(), self.null[d].astype(bool).tolist(), self.ids[d].tolist())
                best = sorted([*best, *found])[:top]
            na, nb = np.concatenate([ta, at + here]), np.concatenate([at, tb])
            new_place, new_most = self.greatest(na, nb)
            rest = ~taken
            a, b = np.concatenate([a[rest], na]), np.concatenate([b[rest], nb])
            place, most = np.concatenate([place[rest], new_place]), np.concatenate([most[rest], new_most])
            bound = np.concatenate([bound[rest], new_most.sum(axis=1)])


def postings(docs: DataFrame, terms: list[bytes], doc_id: str, text: str) -> DataFrame:
    """Blocks of documents with the postings of ``terms``: numbers of documents and of all their terms, documents that hold each term, packed arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        rows: list[tuple] = []
        term: list[int] = []
        tf: list[int] = []

        def block() -> pa.RecordBatch:
            ids, null, n, sizes = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            held, counts = np.unique(np.array(term, np.int32), return_counts=True)
            packed = pack(ids, null.astype(np.uint8), n, sizes.astype(np.int32), np.array(term, np.int32), np.array(tf, np.int32))
            kind = pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.int64())]))
            out = pa.RecordBatch.from_arrays([
                pa.array([len(rows)], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                pa.array([[{"term": t, "docs": c} for t, c in zip(held.tolist(), counts.tolist())]], kind), pa.array([packed], pa.binary())],
                ["docs", "terms", "held", "block"])
            rows.clear(), term.clear(), tf.clear()
            return out

        for table in tables:
            for i, t in zip(table.column("id").to_pylist(), utf8(table.column("text"))):
                words = terms_of(t)
                if not words:
                    continue
                counted = Counter(filter(number.__contains__, words))
                rows.append((i or 0, i is None, len(words), len(counted)))
                term.extend(map(number.__getitem__, counted))
                tf.extend(counted.values())
                if len(rows) >= BLOCK_DOCS or len(term) >= BLOCK_POSTINGS:
                    yield block()
        if rows:
            yield block()
        give_back()

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


def _queries(queries: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple]]:
    """Groups of (id, distinct terms), of at most ``GROUP_TERMS`` terms; rows of one id are one query."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({w.decode() for w in terms_of(t)}) for t in utf8(texts)], pa.list_(pa.string()))

    terms = queries.select(F.col(item_id).alias("id"), F.explode(arrow_column(run, "array<string>", item_text)).alias("term"))
    items = terms.groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("id")
    group: list[tuple] = []
    size = 0
    for r in items.toLocalIterator():
        if group and size + len(r["terms"]) > GROUP_TERMS:
            yield group
            group, size = [], 0
        group.append((r["id"], [t.encode() for t in r["terms"]]))
        size += len(r["terms"])
    if group:
        yield group


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every query, of scores over 0, equal scores by rising id."""
    spark = docs.sparkSession
    kind = queries.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    found = []
    for group in _queries(queries, item_id, item_text):
        terms = sorted({t for _, ts in group for t in ts})
        blocks = written(postings(docs, terms, doc_id, text), "postings")
        total = blocks.agg(F.sum("docs"), F.sum("terms")).first()
        if not total[0]:
            break
        held = blocks.select(F.explode("held").alias("h")).groupBy("h.term").agg(F.sum("h.docs").alias("docs")).collect()  # a row for each term of the group
        weights = np.zeros(len(terms), np.int64)
        for r in held:
            weights[r["term"]] = weight(total[0], r["docs"])
        number = {t: i for i, t in enumerate(terms)}
        items = [(i, np.array([number[t] for t in ts], np.int64)) for i, ts in group]
        shared = spark.sparkContext.broadcast((items, weights, total[0], total[1]))

        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, weights, n_docs, n_terms = shared.value
            best: list[list] = [[] for _ in items]
            for table in tables:
                for row in table.column("block"):
                    block = Block(*unpack(row.as_py()), weights, n_docs, n_terms)
                    if len(block.keys):
                        for k, (_, ts) in enumerate(items):
                            best[k] = block.search(ts, best[k], top)
                    del block
                    give_back()
            out = [(i, None if null else d, -s) for (i, _), rows in zip(items, best) for s, null, d in rows]
            names = ["item_id", "doc_id", "score"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _arrow(schema))

        per_task = blocks.select("block").mapInArrow(run, schema)
        found.append(written(per_task.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"), "found"))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], T.StructType([schema[0], T.StructField("rank", T.IntegerType()), schema[1], schema[2]]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)

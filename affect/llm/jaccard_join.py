"""N-gram Jaccard join by vertical partitioning.

All distinct shingles stand in one global order: rising document frequency,
then hash.  Three steps, none of which sends a shingle as a row of its own:

1. *Frequencies.*  Shingle hashes go to hash ranges as packed arrays; each range
   counts the documents of its shingles and returns to every document those
   that some other document has too (with their frequency).  A document of
   which fewer than ``percent`` % are shared can link with nothing and is done;
   documents with the same set become one class with one representative.
2. *Candidates.*  Two sets of that Jaccard similarity share a shingle among the
   first ``n - ceil(percent * n / 100) + 1`` of either in the global order (the
   rarest).  Classes that share one are paired if their sizes allow a link;
   of shingles that stand for the same classes only one is used.
3. *Overlaps.*  The global order is cut at pivots into fragments; for each pair
   and fragment the partial overlap is counted on its own, and the sum per pair
   decides.  A prefix shingle with more than ``PAIRED`` classes is not expanded
   into pairs: its classes are cut into blocks, and a task for each two blocks
   adds up the partial overlap counts of all their pairs, fragment by fragment
   of its shingles, and returns a spanning forest of the links only.

Links and classes are exact (64-bit shingle hashes aside): nothing is sampled
or capped.  Components come from the links.

Cases: words are ``[^\\x20\\x09-\\x0d]+`` after lower-casing A-Z; a text of fewer
than ``k`` words is one shingle; null or empty texts have none and link with
nothing; rows with a null id are counted but link with nothing (component
null); rows repeated with id and text are one document and returned as often
as they came; rows that share an id but not the text are compared each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affect.llm.blobs import pack, part_of, runs, unpack
from affect.llm.common import give_back, giving_back, utf8, written
from affect.llm.components import components
from affect.llm.hashing import batches, mix

SHINGLE = 5
PERCENT = 80
#: Bytes of text whose shingles one hash range gets; shingles gathered before they are sent; rows that are split into words together.
RANGE_BYTES = 8 << 20
SEND = 1_000_000
ROWS = 1000
#: Classes of one prefix shingle that are paired by a join; beyond, classes of a block whose overlaps are counted together.
PAIRED, BLOCK = 256, 512
FRAGMENTS = 4
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOW40 = np.uint64((1 << 40) - 1)


def _tags(texts: list[bytes], ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """With the id, the key of a row: 31 bits of a hash of the text, and whether the id is null."""
    import zlib
    crc = np.fromiter((zlib.crc32(t) for t in texts), np.uint32, len(texts))
    return ((crc >> np.uint32(1)) << np.uint32(1)) | null.astype(np.uint32)


def _send(k: int, parts: int):
    """Arrow batches of (id, text) to packed shingles for each hash range."""
    def flush(gathered: list) -> Iterator[dict]:
        ids, tags, sizes = (np.concatenate([g[i] for g in gathered]) for i in range(3))
        hashes = np.concatenate([g[3] for g in gathered])
        doc = np.repeat(np.arange(len(ids)), sizes)
        part = part_of(hashes, parts)
        #: each document tells its size to the range of its least hash; an empty one to range 0
        home = np.zeros(len(ids), np.int32)
        first = np.cumsum(sizes) - sizes
        home[sizes > 0] = part[first[sizes > 0]]
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for r in range(parts):
            at = order[cuts[r]:cuts[r + 1]]
            docs = np.union1d(doc[at], np.flatnonzero(home == r))
            if len(docs):
                counts = np.bincount(np.searchsorted(docs, doc[at]), minlength=len(docs)).astype(np.uint32)
                low = hashes[at] & LOW40
                yield {"part": r, "data": pack(ids[docs], tags[docs], np.where(home[docs] == r, sizes[docs], -1).astype(np.int32), counts,
                                               low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8))}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
        gathered, size = [], 0
        for batch in (big.slice(i, ROWS) for big in rows for i in range(0, big.num_rows, ROWS)):
            texts = [t.translate(LOWER) for t in utf8(batch.column(1))]
            null = np.array(batch.column(0).is_null())
            ids = np.array(batch.column(0).fill_null(0), np.int64)
            tags = _tags(texts, ids, null)
            for begin, words in batches(texts):
                sets = words.shingle_sets(k)
                end = begin + len(sets)
                sizes = np.array([len(s) for s in sets], np.int64)
                gathered.append((ids[begin:end], tags[begin:end], sizes, np.concatenate(sets)))
                size += int(sizes.sum())
                if size >= SEND:
                    yield from pa.Table.from_pylist(list(flush(gathered)), schema).to_batches()
                    gathered, size = [], 0
                    give_back()
        if gathered:
            yield from pa.Table.from_pylist(list(flush(gathered)), schema).to_batches()
        gathered = []
        give_back()
    return run


def _frequencies(blocks: int):
    """The packed shingles of one hash range: those of several documents go back, with their frequency, to blocks of documents."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, tags, sizes, counts, low, high = ([] for _ in range(6))
        for blob in rows["data"]:
            for to, part in zip((ids, tags, sizes, counts, low, high), unpack(blob)):
                to.append(part)
        ids, tags, sizes, counts = (np.concatenate(x) for x in (ids, tags, sizes, counts))
        h = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        starts, lengths = runs(h)
        keep = np.repeat(lengths > 1, lengths)
        frequency = np.repeat(lengths, lengths)[keep]
        h, doc = h[keep], doc[keep]
        #: place in the global order: frequency, then 48 bits of the hash
        place = (np.minimum(frequency, 32767).astype(np.uint64) << np.uint64(48)) | (mix(h | (np.uint64(key[0]) << np.uint64(40))) >> np.uint64(16))
        block = (mix(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
        held = np.bincount(doc, minlength=len(ids))
        send = np.flatnonzero((held > 0) | (sizes >= 0))
        by_doc = np.argsort(doc, kind="stable")
        place = place[by_doc]
        first = np.cumsum(held) - held
        out = []
        send = send[np.argsort(block[send], kind="stable")]
        cuts = np.searchsorted(block[send], np.arange(blocks + 1))
        for b in range(blocks):
            docs = send[cuts[b]:cuts[b + 1]]
            if len(docs):
                n = held[docs]
                at = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append((b, pack(ids[docs], tags[docs], sizes[docs], n.astype(np.uint32), place[at])))
        return pd.DataFrame(out, columns=["block", "data"])
    return run


def _documents(percent: int):
    """What came back for one block of documents, a row for each: its size and, if it may link, its shared shingles in the global order."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, tags, sizes, counts, places = ([] for _ in range(5))
        for blob in rows["data"]:
            for to, part in zip((ids, tags, sizes, counts, places), unpack(blob)):
                to.append(part)
        ids, tags, sizes, counts, places = (np.concatenate(x) for x in (ids, tags, sizes, counts, places))
        pairs = np.stack([ids, tags.astype(np.int64)], 1)
        keys, doc = np.unique(pairs, axis=0, return_inverse=True)
        doc = doc.reshape(-1)
        at_home = sizes >= 0
        copies = np.bincount(doc[at_home], minlength=len(keys))
        n = np.zeros(len(keys), np.int64)
        n[doc[at_home]] = sizes[at_home]
        of = np.repeat(doc, counts)
        order = np.lexsort((places, of))
        of, places = of[order], places[order]
        if len(of):  # a repeated row sent its shingles again
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (places[1:] != places[:-1])])
            of, places = of[new], places[new]
        cuts = np.searchsorted(of, np.arange(len(keys) + 1))
        need = -(-percent * n // 100)
        out = []
        for i, (doc_id, tag) in enumerate(keys):
            a, b = cuts[i], cuts[i + 1]
            null = bool(tag & 1)
            may = not null and n[i] > 0 and b - a >= need[i]
            out.append((None if null else int(doc_id), int(copies[i]), int(n[i]), int(need[i]),
                        places[a:b].astype(np.int64) if may else None, f"{doc_id}:{tag}" if may and b - a < n[i] else None))
        return pd.DataFrame(out, columns=["doc_id", "copies", "n", "need", "places", "alone"]).astype({"doc_id": "Int64"})
    return run


def _block_links(percent: int):
    """Links between the classes of two blocks (or within one) as a spanning forest."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node")
        sets, n, node = list(rows["places"]), rows["n"].to_numpy(), rows["node"].to_numpy()
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shingles, column = np.unique(np.concatenate(sets), return_inverse=True)
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for begin in range(0, len(shingles), width):  # the partial overlaps of one fragment after another
            a, b = np.searchsorted(column, (begin, begin + width))
            has = np.zeros((len(sets), width), np.float32)
            has[of[a:b], column[a:b] - begin] = 1
            overlap += has @ has.T
        linked = 100 * overlap >= percent * (n[:, None] + n[None, :] - overlap)
        np.fill_diagonal(linked, True)
        label = np.arange(len(sets))
        while True:
            least = np.where(linked, label[None, :], len(sets)).min(1)
            if (least == label).all():
                break
            label = least[least]
        off = np.flatnonzero(label != np.arange(len(sets)))
        return pd.DataFrame({"a": node[off], "b": node[label[off]]})
    return run


def shared_shingles(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Step 1, written: a row for each document (``copies``: times it came), its set size ``n``, the
    overlap that a link takes at least (``need``), and ``places``, its shared shingles in the global order, if it may link."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // RANGE_BYTES))
    sent = rows.mapInArrow(_send(k, parts), "part int, data binary")
    back = sent.groupBy("part").applyInPandas(giving_back(_frequencies(parts)), "block int, data binary")
    found = back.groupBy("block").applyInPandas(giving_back(_documents(percent)), "doc_id long, copies long, n long, need long, places array<long>, alone string")
    return written(found, "shingles")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``: size of
    its set and the smallest id reachable over links (Jaccard similarity of
    ``percent`` % or more), its own included."""
    found = shared_shingles(docs, k, percent, doc_id, text).withColumn(
        "class", F.when(F.col("places").isNotNull(), F.coalesce("alone", F.sha2(F.array_join("places", ","), 256))))
    reps = (found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rid"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("places").alias("places"))
            .select(F.monotonically_increasing_id().alias("node"), "*"))
    reps = written(reps, "classes")
    prefix = reps.select("node", "n", F.explode(F.slice("places", 1, F.greatest(F.lit(0), (F.size("places") - F.col("need") + 1).cast("int")))).alias("h"))
    prefix = written(prefix, "prefixes")
    # shingles of the same classes give the same pairs: of those one is enough (128 bits of hashes tell)
    several = prefix.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    several = several.where("c > 1").groupBy("c", "x", "y").agg(F.min("h").alias("h")).select("h", "c")
    buckets = prefix.join(several, "h")

    few = buckets.where(F.col("c") <= paired)
    a, b = few.select("h", F.col("node").alias("a"), F.col("n").alias("na")), few.select("h", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = (a.join(b, "h").where("(na < nb or (na = nb and a < b)) and nb * {0} <= na * 100".format(percent))
             .select("a", "b", "na", "nb").distinct())
    quarter = [F.element_at("places", F.greatest(F.lit(1), F.ceil(F.size("places") * i / FRAGMENTS).cast("int"))) for i in range(1, FRAGMENTS)]
    pivots = reps.agg(*[F.percentile_approx(q, 0.5) for q in quarter]).first()
    cuts = [-1, *sorted(p or 0 for p in pivots)]
    # the last fragment has no upper bound: places of frequent shingles reach almost 1 << 63
    fragments = [F.expr(f"filter(places, x -> x > {lo} and x <= {hi})") for lo, hi in zip(cuts, cuts[1:])] + [F.expr(f"filter(places, x -> x > {cuts[-1]})")]
    pieces = reps.select("node", F.posexplode(F.array(*fragments)).alias("f", "piece")).where(F.size("piece") > 0)
    left = pieces.select(F.col("node").alias("a"), "f", F.col("piece").alias("pa"))
    right = pieces.select(F.col("node").alias("b"), "f", F.col("piece").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    links = (partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
             .where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b"))

    parts = F.ceil(F.col("c") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    many = (buckets.where(F.col("c") > paired).select("h", "node", parts.alias("parts"), mine.alias("mine"))
            .select("h", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            .select("h", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
            .join(reps.select("node", "n", "places"), "node"))
    links = links.union(many.groupBy("h", "i", "j").applyInPandas(giving_back(_block_links(percent)), "a long, b long"))
    roots = components(links)
    named = roots.join(reps.select("node", "class", "rid"), "node")
    least = named.groupBy("root").agg(F.min("rid").alias("component_id"))
    of_class = (reps.select("class", "node", "rid").join(named.select("node", "root"), "node", "left").join(least, "root", "left")
                .select("class", F.coalesce("component_id", "rid").alias("component_id")))
    out = found.select("doc_id", "copies", F.col("n").alias("n_shingles"), "class").join(of_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")

"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping blocks of ``window // 2`` words (the
index), and every rolling window of that many words probes it.  A run of
``window`` words holds at least one whole block of its own text wherever it
starts, so whatever repeats over a run is hit there.  Hits are extended: all
runs of ``window`` words around a hit block are compared as a whole, those that
also start earlier are marked, and marks that touch or overlap join into the
maximal exact repeats.

1. Probes and blocks go to hash ranges as packed arrays (a few bytes a word);
   each range returns the blocks that some other window equals.
2. The texts meet their hit blocks; hashes of the runs around them go to hash
   ranges, which return the runs that are not the first of their kind.
3. The texts meet their repeated runs and lose those words.

A run's first occurrence is that of the smallest id, then of the smallest
start; runs are judged on the input, not on what is left.  Nothing is sampled
or capped; a hash range holds as many hashes as its share of the words, and a
passage in very many documents is no pair of them anywhere.

Cases: words are ``[^\\x20\\x09-\\x0d]+``, unchanged; a null or empty text has no
words and nothing removed, its kept text is empty; a null id counts as later
than all others; equal places of rows that share an id are equally early, so a
row repeated as a whole removes nothing of itself and is returned as often as
it came.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affect.llm.blobs import pack, part_of, runs, unpack
from affect.llm.common import give_back, giving_back, utf8, written
from affect.llm.hashing import batches

WINDOW = 20
#: Bytes of text whose hashes one hash range, and whose texts one block of documents gets.
RANGE_BYTES = 8 << 20
SEND = 1_000_000
ROWS = 1000
NULL = np.iinfo(np.int64).max
SENT = pa.schema([("part", pa.int32()), ("data", pa.binary())])


def _tags(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) for t in texts), np.uint32, len(texts))


def _concat(blobs: list[bytes], n: int) -> list[np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(n)]


def _places(counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rising places of several documents from their differences."""
    total = np.cumsum(steps.astype(np.int64))
    ends = np.cumsum(counts)
    before = np.concatenate([[0], total])[ends - counts]
    return total - np.repeat(before, counts)


def _steps(counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    steps[first] = places[first]
    return steps.astype(np.uint32)


def _by_part(parts: int, part: np.ndarray, doc: np.ndarray, place: np.ndarray, extra: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Entries (rising by document and place) dealt to parts, with the keys of the documents that each part gets entries of."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for r in range(parts):
        at = order[cuts[r]:cuts[r + 1]]
        if len(at):
            starts, counts = runs(doc[at])
            docs = doc[at][starts]
            yield r, pack(*[k[docs] for k in keys], counts.astype(np.uint32), _steps(counts, place[at]), *[e[at] for e in extra])


def _probes(k: int, least: int, parts: int):
    """Arrow batches of (id, block, text) to the packed probes of each hash range; texts of fewer than ``least`` words have none."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0

        def flush() -> list[pa.RecordBatch]:
            ids, blocks, tags, counts, places, hashes = (np.concatenate(x) for x in zip(*gathered))
            doc = np.repeat(np.arange(len(ids)), counts)
            out = [{"part": r, "data": data} for r, data in _by_part(parts, part_of(hashes, parts), doc, places, [(hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)], [ids, blocks, tags])]
            return pa.Table.from_pylist(out, SENT).to_batches()

        for batch in (big.slice(i, ROWS) for big in rows for i in range(0, big.num_rows, ROWS)):
            texts = list(utf8(batch.column(2)))
            ids, blocks, tags = np.array(batch.column(0).fill_null(int(NULL)), np.int64), np.array(batch.column(1), np.int32), _tags(texts)
            for begin, words in batches(texts):
                end = begin + len(words.offsets) - 1
                hashes, at = words.windows(k)
                long = np.diff(words.offsets) >= least
                keep = long[words.text[at]]
                hashes, at = hashes[keep], at[keep]
                doc = words.text[at]
                gathered.append((ids[begin:end], blocks[begin:end], tags[begin:end], np.bincount(doc, minlength=end - begin), at - words.offsets[doc], hashes))
                size += len(at)
                if size >= SEND:
                    yield from flush()
                    gathered, size = [], 0
                    give_back()
        if gathered:
            yield from flush()
        gathered = []
        give_back()
    return run


def _anchors(k: int, blocks: int):
    """The probes of one hash range: blocks (places that ``k`` divides) that another window equals go back to their documents."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, block, tags, counts, steps, h = _concat(list(rows["data"]), 6)
        places, doc = _places(counts, steps), np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(h, kind="stable")
        starts, lengths = runs(h[order])
        again = np.empty(len(h), bool)
        again[order] = np.repeat(lengths > 1, lengths)
        hit = np.flatnonzero(again & (places % k == 0))
        by_block = list(_by_part(blocks, block[doc[hit]], doc[hit], places[hit], [], [ids, tags]))
        return pd.DataFrame(by_block, columns=["block", "data"])
    return run


def _marks(blobs: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """Places by (id, tag) of the document."""
    if not blobs:
        return {}
    ids, tags, counts, steps = _concat(blobs, 4)
    places = _places(counts, steps)
    doc = np.repeat(np.arange(len(ids)), counts)
    keys, of = np.unique(np.stack([ids, tags.astype(np.int64)], 1), axis=0, return_inverse=True)
    of = of.reshape(-1)[doc]
    order = np.lexsort((places, of))
    cuts = np.searchsorted(of[order], np.arange(len(keys) + 1))
    return {(int(i), int(t)): places[order[a:b]] for (i, t), a, b in zip(keys, cuts[:-1], cuts[1:])}


def _texts(rows: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    texts = [t.encode() if t else b"" for t in rows["text"]]
    return texts, rows["doc_id"].fillna(int(NULL)).to_numpy(np.int64) if rows["doc_id"].dtype == object else rows["doc_id"].astype("Int64").fillna(int(NULL)).to_numpy(np.int64), _tags(texts)


def _runs_around(window: int, parts: int):
    """Texts of one block of documents and their hit blocks to the packed hashes of the runs that hold hit blocks only."""
    k = window // 2

    def run(key: tuple, rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        marks, out = _marks(list(hits["data"])), []
        texts, ids, tags = _texts(rows) if marks else ([], None, None)
        known = [i for i in range(len(texts)) if (int(ids[i]), int(tags[i])) in marks]
        for begin, words in batches([texts[i] for i in known]):
            some = np.array(known[begin:begin + len(words.offsets) - 1])
            hashes, at = words.windows(window)
            doc = words.text[at]
            start = at - words.offsets[doc]
            # for every word: is it the first of a hit block?
            hit = np.zeros(len(words.hashes) + window, bool)
            for j, i in enumerate(some):
                hit[words.offsets[j] + marks[int(ids[i]), int(tags[i])]] = True
            first = at + (-start) % k
            keep = hit[first] & (hit[first + k] | (start % k != 0))
            at, doc, start, hashes = at[keep], doc[keep], start[keep], hashes[keep]
            if len(at):
                block = np.full(len(some), key[0], np.int32)
                out += _by_part(parts, part_of(hashes, parts), doc, start, [hashes], [ids[some], block, tags[some]])
        return pd.DataFrame(out, columns=["part", "data"])
    return run


def _repeats(blocks: int):
    """The runs of one hash range: all but the first of each kind go back to their documents."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, block, tags, counts, steps, h = _concat(list(rows["data"]), 6)
        places, doc = _places(counts, steps), np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((places, ids[doc], h))
        starts, lengths = runs(h[order])
        of_first = np.repeat(order[starts], lengths)
        later = np.empty(len(h), bool)
        later[order] = (ids[doc[order]] != ids[doc[of_first]]) | (places[order] != places[of_first])
        hit = np.flatnonzero(later)
        return pd.DataFrame(list(_by_part(blocks, block[doc[hit]], doc[hit], places[hit], [], [ids, tags])), columns=["block", "data"])
    return run


def _cut(window: int):
    """Texts of one block of documents without their repeated runs."""
    def run(key: tuple, rows: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        marks = _marks(list(repeats["data"]))
        texts, ids, tags = _texts(rows)
        out = []
        for i, text in enumerate(texts):
            words = text.split()
            starts = marks.get((int(ids[i]), int(tags[i])))
            if starts is None:
                out.append((len(words), 0, [], b" ".join(words).decode()))
                continue
            gone = np.zeros(len(words) + 1, np.int32)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2])]
            out.append((len(words), int(gone.sum()), spans, b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()))
        made = pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "kept"])
        made.insert(0, "doc_id", rows["doc_id"].array)
        return made
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` for every row: the maximal
    repeated spans (numbers of words, end exclusive) and the words left, joined
    by single spaces.  ``window`` is even."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // RANGE_BYTES))
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts)).cast("int")
    rows = rows.select("doc_id", block.alias("block"), "text")
    k = window // 2
    sent = rows.mapInArrow(_probes(k, window, parts), "part int, data binary")
    hits = written(sent.groupBy("part").applyInPandas(giving_back(_anchors(k, parts)), "block int, data binary"), "anchors")
    around = rows.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(giving_back(_runs_around(window, parts)), "part int, data binary")
    repeats = written(around.groupBy("part").applyInPandas(giving_back(_repeats(parts)), "block int, data binary"), "repeats")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept string"
    return rows.groupBy("block").cogroup(repeats.groupBy("block")).applyInPandas(giving_back(_cut(window)), schema)

"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
windows of all test items, each text scanned once, hits mapped back to the text.

Normal form: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined
and enclosed by single spaces.  A window is ``window`` consecutive words of an
item (all of a shorter one); in normal form it starts and ends with a space, so
that it matches whole words only.  The byte ranges of words are the same before
and after normalising (it maps byte to byte), which gives the hits' offsets.

Cases: a null or empty text has no words and no hits; items without words or
with a null id have no windows; items that share a window are all reported; a
repeated row is judged like any other; an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affect.llm.common import arrow_column, fresh, once_a_process, utf8

WINDOW = 10
#: Items are put into one automaton up to this many characters; more items make several, one scan each.
AUTOMATON_CHARS = 8 << 20
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RETURNS = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: int, end: int>>>"


def windows_of(items: list[tuple[str, str]], window: int) -> dict[str, list[str]]:
    """Each window in normal form (bytes as Latin-1) with the ids of the items that have it."""
    out: dict[str, list[str]] = {}
    for item, text in items:
        words = text.encode().translate(NORMAL).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            ids = out.setdefault((b" " + b" ".join(words[i:i + window]) + b" ").decode("latin-1"), [])
            if item not in ids:
                ids.append(item)
    return out


def build(windows: dict[str, list[str]]) -> ahocorasick.Automaton | None:
    if not windows:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, ids in windows.items():
        automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, ids))
    automaton.make_automaton()
    return automaton


def scan(text: bytes, automaton: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, the merged ranges of hit words, and the sorted items of the hits."""
    words = text.translate(NORMAL).split()
    if automaton is None or not words:
        return len(words), [], []
    normal = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(normal.decode("latin-1")))
    if not found:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    first = np.searchsorted(spaces, [end - length + 1 for end, (length, _, _) in found])
    ranges: list[tuple[int, int]] = []
    for a, b in sorted((int(i), int(i) + n) for i, (_, (_, n, _)) in zip(first, found)):
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return len(words), ranges, sorted({i for _, (_, _, ids) in found for i in ids})


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets in ``text`` (end exclusive) of ranges of words."""
    if not ranges:
        return []
    normal = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], normal, [False]]).view(np.int8)))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[edges[2 * a]]), "end": int(chars[edges[2 * b - 1]])} for a, b in ranges]


def _merge(one: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(one + other):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                  item_id: str = "item_id", item_text: str = "text", into: str = "contamination",
                  automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``docs`` with a struct column ``into`` (made longer if taken): number of
    words, hit words, the ids of the items with occurring windows, sorted as
    strings, and code point spans of the hits.  No shuffle: the automaton is
    broadcast, and its size is checked; a benchmark of more than
    ``automaton_chars`` characters is cut into blocks, one automaton each, that
    scan the text in turn."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // automaton_chars) or 1
    blocks = []
    for b in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b) if n_blocks > 1 else items
        blocks.append(spark.sparkContext.broadcast([(r["id"], r["text"]) for r in part.collect()]))

    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        automata = once_a_process("automata", key, lambda: [build(windows_of(block.value, window)) for block in blocks])
        out = []
        for t in utf8(texts):
            n, ranges, ids = scan(t, automata[0])
            for more in automata[1:]:
                _, r, i = scan(t, more)
                ranges, ids = _merge(ranges, r), sorted({*ids, *i})
            out.append({"n_words": n, "n_hit": sum(b - a for a, b in ranges), "items": ids, "spans": char_spans(t, ranges)})
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))]))

    return docs.withColumn(fresh(into, docs), arrow_column(run, RETURNS, text))

"""Phrase collocation mining by top-order marginalisation.

Every word of a text starts one window: the word and up to ``longest - 1``
words that follow it in its piece, as lead columns ``w1 .. w4`` that are null
past the piece's end.  Only these padded longest windows are counted, once a
word; the counts of all shorter phrases come from them by Spark's ROLLUP over
``lang, w1, w2, w3, w4``, which sums successively shorter prefixes up to the
number of words of a language.

Shuffle: a task counts its windows before it sends them, packed into one
compressed record for each range of hashes of (lang, first two words).  All
windows that begin with a pair of words meet in one range, so whoever merges a
range knows the exact count of every prefix of two or more words in it and pads
each window behind its longest prefix that reaches ``least``; what ROLLUP then
gets is the frequent phrases and a few rows a word.  A range of more than
``HELD`` distinct windows is sent on without padding: the result is the same,
ROLLUP has more to sum.  Equal windows are told by two 64-bit hashes together.

Rules: A-Z are lower-cased; texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]``
and pieces into words ``[^\\x20\\x09]+``.  ``n`` counts the words of a language,
``f`` the occurrences of a phrase within pieces, overlaps included.  Candidates
have two to ``longest`` words and ``a = f >= least``.  A cut after the first k
words gives ``l``, ``r`` and ``floor(2000000 * a / (l + r))``, in decimals of 38
digits; the lowest cut counts, ties to the smallest k.  A candidate goes if a
longer candidate holds its words side by side and has ``share`` percent of its
count or more.  Ranked by score, a (both falling) and phrase (bytes), the first
``top`` of each language stay.

Cases: null and empty texts have no words; a null ``lang`` is ``und``; repeated
rows count as often as they stand; an empty table gives no rows; other columns
are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affect.llm.blobs import pack, part_of, unpack
from affect.llm.common import give_back, utf8, written
from affect.llm.hashing import BYTE_BASE, U64, WORD_BASE, mix, ranges_hash

LONGEST = 4
LEAST = 30
SHARE = 80
TOP = 2000
#: Bytes of text for each range of hashes.
RANGE_BYTES = 4 << 20
#: Bytes of text whose windows are made together, windows that a task holds before it sends them, distinct windows that a range holds.
SLICE_BYTES, SENT, HELD = 1 << 20, 600_000, 1_500_000
#: What a byte is (1: between words, 2: between pieces), and its small letter.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
MULTIPLIERS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93)]
SENDS = "bucket int, lang string, windows binary"


def canonical(texts: list[bytes]) -> np.ndarray:
    """The words of all texts, in small letters, each followed by a space, or by a line end where its piece ends."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = KIND[raw]
    after = np.flatnonzero((kind[1:] > 0) & (kind[:-1] == 0)) + 1  # the byte after each word
    if not len(after):
        return np.zeros(0, np.uint8)
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    starts = np.flatnonzero((np.concatenate([[1], kind[:-1]]) > 0) & (kind == 0))
    out = SMALL[raw]
    next_break = np.append(breaks[starts[1:]], breaks[-1] + 1)
    out[after] = np.where(next_break > breaks[after - 1], 10, 32)
    keep = kind == 0
    keep[after] = True
    return out[keep]


class Windows:
    """Windows of up to ``longest`` words that begin at each word of a canonical text (or, of lines, at each line)."""

    def __init__(self, raw: np.ndarray, lang: str, longest: int, lines: bool = False):
        self.raw = raw
        ends = np.flatnonzero((raw == 32) | (raw == 10))
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        words = ranges_hash(raw.astype(U64) + U64(1), starts, ends, BYTE_BASE)
        last = raw[ends] == 10
        first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if lines else np.arange(len(ends))
        seed = mix(np.array([sum((b + 1) * pow(257, i, 1 << 61) for i, b in enumerate(lang.encode())) % (1 << 61)], U64))
        self.starts, self.n = starts[first], np.ones(len(first), np.int8)
        self.ends = [ends[first]]
        #: hashes of the prefixes of 1, 2, .. words; of a shorter window the last ones repeat the whole one's
        self.prefixes = [mix(words[first] * MULTIPLIERS[0] + seed)]
        inside = ~last[first]
        for j in range(1, longest):
            at = np.where(inside, first + j, 0)
            h = np.where(inside, mix(self.prefixes[-1] * MULTIPLIERS[j % 4] + words[at]), self.prefixes[-1])
            self.prefixes.append(h)
            self.ends.append(np.where(inside, ends[at], self.ends[-1]))
            self.n += inside
            inside = inside & ~last[at]
        #: a second hash of the whole window, of its bytes
        self.check = ranges_hash(raw.astype(U64) + U64(1), self.starts, self.ends[-1], WORD_BASE)


def _cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the ranges, a line end after each."""
    sizes = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    out = raw[np.minimum(np.repeat(starts - total[:-1], sizes) + np.arange(total[-1]), len(raw) - 1)]
    out[total[1:] - 1] = 10
    return out


def _distinct(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct window, and for each window the number of its distinct one."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    if (check[first][number] != check).any():  # two windows of one hash: tell them by both
        _, first, number = np.unique(np.stack([hashes, check]), axis=1, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


class _Held:
    """Windows of one language with counts, their texts cut out; equal ones become one when asked.
    Of the hashes of prefixes only those of ``lengths`` (from 0, the longest last) are kept."""

    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = lengths
        self.parts: list[tuple] = []  # prefixes, check, counts, texts, ends of the texts
        self.size = 0

    def add(self, w: Windows, counts: np.ndarray | None) -> None:
        """Equal windows of ``w`` are added as one, so that what is held is small."""
        first, number = _distinct(w.prefixes[-1], w.check)
        total = np.bincount(number, weights=counts, minlength=len(first)).astype(np.int64)
        text = _cut(w.raw, w.starts[first], w.ends[-1][first])
        self.parts.append(([w.prefixes[j][first] for j in self.lengths], w.check[first], total, text, np.cumsum(w.ends[-1][first] - w.starts[first] + 1), w.n[first]))
        self.size += len(first)

    def merged(self) -> tuple:
        """One part for all."""
        if len(self.parts) > 1:
            prefixes = [np.concatenate(p) for p in zip(*(x[0] for x in self.parts))]
            check, counts, text, n = (np.concatenate([x[i] for x in self.parts]) for i in (1, 2, 3, 5))
            shift = np.cumsum([0] + [len(x[3]) for x in self.parts])
            ends = np.concatenate([x[4] + s for x, s in zip(self.parts, shift)])
            starts = np.concatenate([[0], ends[:-1]])
            first, number = _distinct(prefixes[-1], check)
            # counts are whole numbers under 2**53 in a task
            total = np.bincount(number, weights=counts, minlength=len(first)).astype(np.int64)
            text = _gather(text, starts[first], ends[first])
            self.parts = [([p[first] for p in prefixes], check[first], total, text, np.cumsum(ends[first] - starts[first]), n[first])]
            self.size = len(first)
        return self.parts[0]


def _gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 100_000) -> np.ndarray:
    """The bytes of the ranges one after another, made a block at a time."""
    out = []
    for i in range(0, len(starts), block):
        a, sizes = starts[i:i + block], (ends - starts)[i:i + block]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out.append(raw[np.repeat(a - total[:-1], sizes) + np.arange(total[-1])])
    return np.concatenate(out) if out else raw[:0]


def _send(lang: str, held: _Held, parts: int) -> Iterator[tuple[int, str, bytes]]:
    prefixes, _, counts, text, ends, _ = held.merged()
    pair = prefixes[0]
    order = np.argsort(pair, kind="stable")  # ranges are by the pair's hash, and equal pairs stand together
    starts = np.concatenate([[0], ends[:-1]])
    ranges = part_of(pair[order], parts)
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], ranges, [parts]])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        yield int(ranges[a]), lang, pack(_gather(text, starts[at], ends[at]), counts[at])


def windows(docs: DataFrame, text: str, lang: str, longest: int, least: int) -> DataFrame:
    """``lang, w1 .. w<longest>, c``: padded longest windows with counts, behind their longest frequent prefix."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(1 + size // RANGE_BYTES, 1 << 24)

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        full = 0

        def sent() -> pa.RecordBatch:
            rows = [r for name in sorted(held) if held[name].parts for r in _send(name, held[name], parts)]
            held.clear()
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[], [], []], (pa.int32(), pa.string(), pa.binary()))], ["bucket", "lang", "windows"])

        for table in tables:
            waiting: dict[str, tuple[list[bytes], int]] = {}
            langs = table.column("lang").to_pylist()
            for name, t in zip(langs, utf8(table.column("text"))):
                texts, n = waiting.setdefault(name, ([], 0))
                texts.append(t)
                waiting[name] = (texts, n + len(t))
                if n + len(t) >= SLICE_BYTES:
                    full += _add(held, name, waiting.pop(name)[0], longest)
                if full >= SENT:
                    yield sent()
                    full = 0
            for name, (texts, _) in waiting.items():
                full += _add(held, name, texts, longest)
        if held:
            yield sent()

    def merge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole = None, {}, True
        for table in tables:
            for bucket, name, blob in zip(*(table.column(c).to_pylist() for c in ("bucket", "lang", "windows"))):
                if bucket != now:
                    yield from _padded(held, longest, least if whole else 0)
                    now, held, whole = bucket, {}, True
                    give_back()
                raw, counts = unpack(blob)
                held.setdefault(name, _Held(tuple(range(longest)))).add(Windows(raw, name, longest, lines=True), counts)
                if sum(h.size for h in held.values()) > HELD:
                    for h in held.values():
                        h.merged()
                    if sum(h.size for h in held.values()) > HELD // 2:
                        whole = False
                        yield from _padded(held, longest, 0)
                        held = {}
        yield from _padded(held, longest, least if whole else 0)
        give_back()

    names = [f"w{j + 1}" for j in range(longest)]
    sends = docs.mapInArrow(count, SENDS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sends.mapInArrow(merge, ", ".join(["lang string", *[f"{c} string" for c in names], "c bigint"]))


def _add(held: dict[str, _Held], name: str, texts: list[bytes], longest: int) -> int:
    raw = canonical(texts)
    if not len(raw):
        return 0
    h = held.setdefault(name, _Held((min(1, longest - 1), longest - 1)))  # ranges go by the pair
    before = h.size
    h.add(Windows(raw, name, longest), None)
    return h.size - before


def _padded(held: dict[str, _Held], longest: int, least: int, block: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows of what is held.  With ``least``, a window keeps its longest prefix of that count or more (its first word at
    least), and windows that become equal one row; with 0 windows stay as they are."""
    for name, h in held.items():
        if not h.parts:
            continue
        prefixes, _, counts, text, ends, n = h.merged()
        starts = np.concatenate([[0], ends[:-1]])
        if least:
            keep = np.ones(len(counts), np.int8)
            for j in range(1, longest):
                _, number = np.unique(prefixes[j], return_inverse=True)
                # of shorter windows the hash is of a shorter prefix, which no longer prefix shares
                often = np.bincount(number, weights=counts)[number] >= least
                keep[often & (n > j)] = j + 1
            key = prefixes[0].copy()
            for j in range(1, longest):
                key[keep == j + 1] = prefixes[j][keep == j + 1]
            _, first, number = np.unique(key, return_index=True, return_inverse=True)
            counts = np.bincount(number, weights=counts, minlength=len(first)).astype(np.int64)
            starts, ends, keep = starts[first], ends[first], keep[first]
        else:
            keep = n
        names = [f"w{j + 1}" for j in range(longest)]
        for i in range(0, len(counts), block):
            columns: list[list] = [[] for _ in range(longest)]
            whole = text.tobytes() if not i else whole
            for a, b, k in zip(starts[i:i + block].tolist(), ends[i:i + block].tolist(), keep[i:i + block].tolist()):
                words = whole[a:b - 1].split(b" ")[:k]
                for j in range(longest):
                    columns[j].append(words[j] if j < k else None)
            arrays = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns]
            size = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), *arrays, pa.array(counts[i:i + block], pa.int64())], ["lang", *names, "c"])


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang, len, phrase, f`` of every phrase of up to ``longest`` words with ``f >= least``, and of
    each language one row of ``len`` 0 and the empty phrase with its number of words.  One ROLLUP over the counted windows."""
    names = [f"w{j + 1}" for j in range(longest)]
    rolled = windows(docs, text, lang, longest, least).rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    # the lowest bits of g are the words that were summed away; the last word that was not is null where a window is padded
    length = sum((F.col("g").bitwiseAND(1 << j) == 0).cast("int") for j in range(longest))
    kept = F.array(F.lit("lang"), *names)[F.col("len")].isNotNull() & ((F.col("len") == 0) | (F.col("f") >= least))
    return (rolled.withColumn("len", length).where((F.col("g") < (1 << longest)) & kept)
            .select("lang", "len", F.concat_ws(" ", *[F.when(F.col("len") > j, F.col(c)) for j, c in enumerate(names)]).alias("phrase"), "f"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 share: int = SHARE, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of each language."""
    counted = written(phrases(docs, text, lang, longest, least), "phrases")
    known = counted.where("len > 0")
    candidates = known.where("len > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1))).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - len)").alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    scored = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0))) div (cast(l as decimal(19, 0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("len") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("len") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    covered = (candidates.where("len > 2").select("lang", "a", F.explode(inner).alias("phrase"))
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = (lowest.join(covered, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank).where(F.col("rank") <= top)
    totals = counted.where("len = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))

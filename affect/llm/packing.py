"""Best-fit packing: best-two-fit into sequences of a fixed number of tokens.

Every text becomes the tokens of a public tokenizer and one end token; only
longer ones are cut.  Pieces are dealt at random into groups of about
``GROUP`` pieces, and each group is packed by one task: a sequence is filled
greedily (the longest unpacked piece that fits the gap, again and again), then
its smallest piece is exchanged for the two unpacked pieces that fill the gap
so widened best, if they fill more.  A group leaves about one sequence that is
not full, so the loss against one global packing is of the order of
``1 / (sequences in a group)``, and work and memory of a task are bounded.

Cases: a null or empty text has only the end token; repeated rows are pieces of
their own; the empty table gives no row; ties go to the piece that comes first
by id, piece and checksum.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affect.llm.common import arrow_column, giving_back, once_a_process, utf8, written
from affect.llm.hashing import BYTE_BASE, ranges_hash

TOKENS = 4096
END = 1
GROUP = 1 << 16
#: Tokens of frequent words are kept by each worker, up to so many words.
CACHE = 300_000
#: A vocabulary file larger than this is not broadcast.
VOCABULARY_BYTES = 64 << 20
PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts tokenized together, in bytes.
BATCH_BYTES = 2 << 20
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = SIGN
KINDS[48:58] = DIGIT
KINDS[97:123] = KINDS[65:91] = LETTER
KINDS[39] = OTHER  # the tokenizer keeps an apostrophe together with some endings
KINDS[[10, 32]] = SPACE


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer composes and lower-cases characters, then splits at white
    space, between letters and other signs and around digits, and only then
    merges; the last token of each such part is marked as a word's end.  So a
    text's tokens are those of its parts in order.  Parts are what stands
    between spaces and line feeds, cut further where ASCII or Latin letters,
    digits and ASCII signs meet if the part has nothing else; A-Z may be
    lower-cased before.  The distinct parts of a batch of texts are found by
    their hashes and looked up in what the process knows; new ones of letters
    only are encoded many at once and told apart by the word ends.  Texts with
    special tokens are left to the tokenizer whole, and so are those with
    combining marks (h with a macron composes, H does not)."""

    def __init__(self, vocabulary: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] + [b"\xcc", b"\xcd"]
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        letters, rest = [], []
        for w in new:
            word = w.decode()
            (letters if word.isalpha() else rest).append(word)
        for i in range(0, len(letters), 500):
            some = letters[i:i + 500]
            flat = np.frombuffer(self.encode([" ".join(some)])[0], "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()
            if len(cuts) == len(some):
                flat = flat.tobytes()
                self.known.update((w.encode(), flat[a:b]) for w, a, b in zip(some, [0, *cuts], cuts))
            else:
                rest += some
        self.known.update(zip((w.encode() for w in rest), self.encode(rest)))

    @staticmethod
    def parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts of lower-cased text that starts and ends with spaces."""
        kind = KINDS[raw]
        latin = np.flatnonzero((raw >= 0xC3) & (raw <= 0xCA))  # the first of two bytes of a Latin letter
        latin = latin[~((raw[latin] == 0xC3) & ((raw[latin + 1] == 0x97) | (raw[latin + 1] == 0xB7)))]  # but the signs of times and division
        kind[latin] = kind[latin + 1] = LETTER
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        before, after = kind[change - 1], kind[change]
        starts, ends, inside = change[before == SPACE], change[after == SPACE], change[(before != SPACE) & (after != SPACE)]
        if len(inside):
            plain = np.add.reduceat(kind == OTHER, starts) == 0
            inside = inside[plain[np.searchsorted(starts, inside, side="right") - 1]]
            starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
        return starts, ends

    def of_batch(self, texts: list[bytes]) -> list[bytes]:
        """Token ids of texts in which every part stands for itself."""
        buffer = b" " + b" ".join(texts).translate(LOWER) + b" "
        raw = np.frombuffer(buffer, np.uint8)
        starts, ends = self.parts(raw)
        _, first, inverse = np.unique(ranges_hash(raw.astype(np.uint64), starts, ends, BYTE_BASE), return_index=True, return_inverse=True)
        distinct = [buffer[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        ids = list(map(self.known.get, distinct))
        if new := [w for w, x in zip(distinct, ids) if x is None]:
            if len(self.known) + len(new) > CACHE:
                self.known, new = {}, distinct
            self.learn(new)
            ids = list(map(self.known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(ids), "<u4")
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, n = np.cumsum(each) - each, each[inverse]
        to = np.cumsum(n) - n
        total = int(n.sum())
        out = flat[np.repeat(begin[inverse] - to, n) + np.arange(total)]
        text_ends = np.cumsum([len(t) + 1 for t in texts]) + 1
        cuts = np.append(to, total)[np.searchsorted(starts, text_ends)].tolist()
        return [out[a:b].tobytes() for a, b in zip([0, *cuts], cuts)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        whole = {i: self.encode([t.decode()])[0] for i, t in enumerate(texts) if any(x in t for x in self.whole)}
        rest = iter(self.of_batch([t for i, t in enumerate(texts) if i not in whole]) if len(whole) < len(texts) else [])
        return [whole[i] if i in whole else next(rest) for i in range(len(texts))]


def cut(ids: bytes, tokens: int) -> list[dict]:
    """Pieces of at most ``tokens`` ids."""
    step = 4 * tokens
    return [{"piece": i, "start": i * tokens, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
            for i, part in enumerate(ids[at:at + step] for at in range(0, len(ids), step))]


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """The lengths of the pieces of every sequence, in their order there."""
    counts = np.bincount(lengths, minlength=size + 1)[:size + 1]
    numbers = np.arange(size + 1)

    def below() -> np.ndarray:  # for every gap the longest unpacked length that fits, or 0
        return np.maximum.accumulate(np.where(counts > 0, numbers, 0))

    fits = below()
    left = len(lengths)
    out = []
    while left:
        row, gap, stale = [], size, False
        while gap and (length := int(fits[gap])):
            row.append(length)
            gap -= length
            left -= 1
            counts[length] -= 1
            if not counts[length]:
                fits = below()
        if gap and left > 1:
            small = row[-1]
            wide = gap + small
            one = np.flatnonzero(counts[:wide])
            two = fits[wide - one]
            two = np.where((one == two) & (counts[one] < 2), fits[np.maximum(one - 1, 0)], two)
            both = np.where(two > 0, one + two, 0)
            if len(both) and both.max() > small:
                at = int(both.argmax())
                pair = sorted((int(one[at]), int(two[at])), reverse=True)
                row[-1:] = pair
                left -= 1
                for length, change in ((small, 1), (pair[0], -1), (pair[1], -1)):
                    stale = stale or (counts[length] == 0) != (counts[length] + change == 0)
                    counts[length] += change
        if stale:
            fits = below()
        out.append(row)
    return out


def _pack(size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        next_of = np.searchsorted(lengths, np.arange(size + 1))
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for s, row in enumerate(best_two_fit(lengths, size)):
            at = 0
            for length in row:
                i = next_of[length]
                next_of[length] += 1
                sequence[i], offset[i] = s, at
                at += length
        rows["sequence_id"] = (np.int64(key[0]) << np.int64(32)) + sequence
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]
    return run


def pieces(docs: DataFrame, vocabulary_file: str, tokens: int = TOKENS, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of every text's tokens.  No shuffle; the vocabulary is broadcast."""
    with open(vocabulary_file, encoding="utf-8") as f:
        vocabulary = f.read(VOCABULARY_BYTES + 1)
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_file} has more than {VOCABULARY_BYTES} characters")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    stop = np.array([end], "<u4").tobytes()
    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        encode = once_a_process("tokenizer", key, lambda: Tokens(shared.value))
        out, part, size = [], [], 0
        for t in utf8(texts):
            part.append(t)
            size += len(t)
            if size > BATCH_BYTES:
                out += [cut(ids + stop, tokens) for ids in encode(part)]
                part, size = [], 0
        out += [cut(ids + stop, tokens) for ids in encode(part)]
        kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        return pa.array(out, pa.list_(kind))

    rows = docs.select(F.col(doc_id).alias("doc_id"), arrow_column(run, PIECES, text).alias("p"))
    return rows.select("doc_id", F.inline("p"))


def pack(cut_pieces: DataFrame, tokens: int = TOKENS, group: int = GROUP) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``.  One shuffle of the pieces' lengths, never of tokens."""
    rows = written(cut_pieces, "pieces")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    kind = dict(rows.dtypes)["doc_id"]
    return dealt.groupBy("group").applyInPandas(
        giving_back(_pack(tokens)), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

"""Secret scans by grammar inference.

Base patterns (fixed values) mark labelled credentials.  From their values a
probabilistic automaton is inferred for each kind: a prefix tree with counts,
on states and on edges, whose states are merged (red-blue order) wherever their edge and end
frequencies agree within Hoeffding's bound, recursively.  Further automata are
inferred from ordinary runs of the same characters: small letters only,
capitals only, digits only, and mixed (without those that fit a credential automaton).  Every candidate of a
text (a whole run of credential characters) is scored by the logarithm of its
likelihood ratio: best credential automaton against the best ordinary one, per
character.  Candidates above a threshold become spans of kind ``format``,
unless a base span has them already; base spans always stay.

Fitting takes a bounded sample (``SAMPLE`` distinct values a kind, those of the
smallest hashes over all texts).  Values are learned whole; of a kind's sample
``LEARNED`` characters are taken at most, whole values by rising hash, and one
that is longer than what is left is passed over.  Scanning reads every whole text.

Cases: null and empty texts have no spans; without labelled values no automaton
is inferred and only base spans are found; spans of one text are ordered by
start, kind and end; offsets are code points.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affect.llm.common import arrow_column, fresh, strings, written

SAMPLE = 1000
#: Characters of a kind's values that an automaton is inferred from, at most (a state of the prefix tree each).
LEARNED = 500_000
#: Runs of credential characters this long or longer are candidates.
CANDIDATE = 12
#: A candidate is reported if its log likelihood ratio per character is over this.
MARGIN = 0.5
#: Characters that credentials are made of.
CHARACTERS = 68
ALPHA = 0.05
ORDINARY = ("lower", "upper", "digits", "mixed")
KINDS = ("assign", "access", "hex", "format")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE)
RETURNS = "array<struct<kind: string, start: int, end: int>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base patterns, in order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def ordinary(value: str) -> str:
    """Which automaton of ordinary runs a value belongs to."""
    letters = value.strip("+/_.=-")
    return "lower" if letters.islower() and letters.isalpha() else "upper" if letters.isupper() and letters.isalpha() else "digits" if letters.isdigit() else "mixed"


def candidates(text: str, known: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Whole runs that no base span touches and that no letter of another script adjoins."""
    out, k = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(known) and known[k][2] <= a:
            k += 1
        if k < len(known) and known[k][0] < b:
            continue
        if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
            continue
        out.append((a, b, m[0]))
    return out


class State:
    """How often strings came here and ended here; for each character how often they went on with it (``taken``) and where to.
    ``count == end + sum(taken)`` always holds, also after merges."""

    __slots__ = ("count", "end", "next", "taken")

    def __init__(self):
        self.count, self.end = 0, 0
        self.next: dict[str, State] = {}
        self.taken: dict[str, int] = {}


def prefix_tree(values: list[str]) -> State:
    root = State()
    for v in values:
        s = root
        s.count += 1
        for c in v:
            s.taken[c] = s.taken.get(c, 0) + 1
            s = s.next.setdefault(c, State())
            s.count += 1
        s.end += 1
    return root


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    return n > 0 and m > 0 and abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(p: State, q: State, alpha: float) -> bool:
    """Whether the shares of ends and of each character at ``p`` and ``q``, and at what follows them, agree."""
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        if _differ(p.end, p.count, q.end, q.count, alpha):
            return False
        for c in p.taken.keys() | q.taken.keys():
            if _differ(p.taken.get(c, 0), p.count, q.taken.get(c, 0), q.count, alpha):
                return False
            if c in p.next and c in q.next and p.next[c] is not q.next[c]:
                todo.append((p.next[c], q.next[c]))
    return True


def _fold(p: State, q: State) -> None:
    """The tree under ``q`` is added to ``p`` and what follows it: counts of states, of ends and of edges."""
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        p.count += q.count
        p.end += q.end
        for c, y in q.next.items():
            if c in p.next:
                p.taken[c] += q.taken[c]
                todo.append((p.next[c], y))
            else:
                p.taken[c], p.next[c] = q.taken[c], y


def infer(values: list[str], alpha: float = ALPHA) -> list[tuple[float, dict[str, tuple[float, int]], float]]:
    """States of the automaton, the first one first: log probability of ending, for each character log probability
    and next state, and log probability of each character that was never seen there (one visit's share for all of them)."""
    root = prefix_tree(sorted(values))
    red, number = [root], {id(root): 0}
    while True:
        blue = next(((r, c) for r in red for c in sorted(r.next) if id(r.next[c]) not in number), None)
        if blue is None:
            break
        parent, c = blue
        child = parent.next[c]
        for r in red:
            if compatible(r, child, alpha):
                parent.next[c] = r
                _fold(r, child)
                break
        else:
            number[id(child)] = len(red)
            red.append(child)
    out = []
    for s in red:
        total = s.count + 1.0  # one count is left for what was never seen
        out.append((math.log((s.end + 1e-3) / total), {c: (math.log(s.taken[c] / total), number[id(t)]) for c, t in s.next.items()},
                    math.log(0.999 / total / max(1, CHARACTERS - len(s.next)))))
    return out


def log_likelihood(automaton: list, value: str) -> float:
    """Of the value and its end; a character that the state has never seen has its share of what is left and starts anew."""
    state, total = 0, 0.0
    for c in value:
        step = automaton[state][1].get(c)
        if step is None:
            total, state = total + automaton[state][2], 0
        else:
            total, state = total + step[0], step[1]
    return total + max(automaton[state][0], -9.0)


def _even(value: str) -> float:
    """Log likelihood where all characters and the end are as likely."""
    return -math.log(66) * (len(value) + 1)


class Grammar:
    """Automata of the kinds and of ordinary runs.

    Bare credentials are among the mixed runs too: those that a kind's automaton takes
    for its own, against even chances of all characters, are not learned as ordinary."""

    def __init__(self, credentials: dict[str, list[str]], plain: dict[str, list[str]], margin: float = MARGIN):
        self.kinds = {k: infer(v) for k, v in credentials.items() if v}
        fits = {v for v in plain.get("mixed", []) if any(log_likelihood(a, v) - _even(v) > margin * (len(v) + 1) for a in self.kinds.values())}
        kept = {k: [x for x in v if k != "mixed" or x not in fits] for k, v in plain.items()}
        self.plain = {k: infer(v) for k, v in kept.items() if v}

    def score(self, value: str) -> float:
        """Log likelihood ratio per character; without automata minus infinity."""
        if not self.kinds:
            return -math.inf
        best = max(log_likelihood(a, value) for a in self.kinds.values())
        plain = max([log_likelihood(a, value) for a in self.plain.values()] + [_even(value)])
        return (best - plain) / (len(value) + 1)


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE, learned: int = LEARNED) -> Grammar:
    """The grammar of the credentials in all texts: one pass that extracts the
    values, of which at most ``sample`` and ``learned`` characters a kind come to the driver."""
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in strings(texts):
            known = base_spans(t)
            rows = [{"kind": KINDS[k], "value": v} for _, k, _, v in known]
            rows += [{"kind": ordinary(v), "value": v} for v in {v for _, _, v in candidates(t, known)}]
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    values = (docs.select(F.explode(arrow_column(run, "array<struct<kind: string, value: string>>", text)).alias("v"))
              .select("v.kind", "v.value").withColumn("h", F.xxhash64("value")))
    chosen = _smallest(values, sample)
    left: dict[str, int] = {}
    over = []
    for r in sorted(chosen.select("h", "kind", F.length("value").alias("n")).collect()):
        if r["n"] <= left.setdefault(r["kind"], learned):
            left[r["kind"]] -= r["n"]
        else:
            over.append(f"{r['kind']}:{r['h']}")
    if over:
        chosen = chosen.where(~F.concat_ws(":", "kind", "h").isin(over))
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.select("kind", "value").collect()):
        found.setdefault(r["kind"], []).append(r["value"])
    return Grammar({k: found.get(k, []) for k in KINDS[:3]}, {k: found.get(k, []) for k in ORDINARY})


def _smallest(values: DataFrame, sample: int) -> DataFrame:
    """The distinct values of the ``sample`` smallest hashes of each kind.

    Hashes are even, so a kind's count tells below which hash about four times
    as many stand; only those are ranked, however many values there are."""
    found = written(values.distinct(), "credentials")
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    share = {k: min(1.0, 4 * sample / n) for k, n in counts.items()}
    while True:
        low = [(F.col("kind") == k) & (F.col("h") <= int(-(1 << 63) + share[k] * ((1 << 64) - 1025))) for k in counts]
        few = found.where(functools.reduce(lambda x, y: x | y, low, F.lit(False)))
        got = {r["kind"]: r["count"] for r in few.groupBy("kind").count().collect()}
        again = [k for k in counts if share[k] < 1 and got.get(k, 0) < sample]
        if not again:
            break
        share.update({k: min(1.0, 4 * share[k]) for k in again})
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    return few.withColumn("rank", rank).where(F.col("rank") <= sample).select("kind", "value", "h")


def spans(text: str, grammar: Grammar, scores: dict[str, float], margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of base spans and of candidates over the margin, in order."""
    known = base_spans(text)
    out = [s[:3] for s in known]
    for a, b, value in candidates(text, known):
        s = scores.get(value)
        if s is None:
            if len(scores) > 100_000:
                scores.clear()
            s = scores[value] = grammar.score(value)
        if s > margin:
            out.append((a, 3, b))
    return sorted(out)


def scan(docs: DataFrame, grammar: Grammar, text: str = "text", margin: float = MARGIN, into: str = "secrets") -> DataFrame:
    """``docs`` with the spans of every text in ``into`` (made longer if taken).  No shuffle; the automata are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    scores: dict[str, float] = {}

    def run(texts: pa.Array) -> pa.Array:
        out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, shared.value, scores, margin)] for t in strings(texts)]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return docs.withColumn(fresh(into, docs), arrow_column(run, RETURNS, text))


def redact(docs: DataFrame, grammar: Grammar, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[SECRET]`` (overlapping spans by one).  Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    scores: dict[str, float] = {}

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for null, t in zip(texts.is_null().to_pylist(), strings(texts)):
            if t:
                kept, at = [], 0
                for a, _, b in spans(t, shared.value, scores, margin):
                    if a >= at:
                        kept += [t[at:a], "[SECRET]"]
                    at = max(at, b)
                t = "".join([*kept, t[at:]])
            out.append(None if null else t)
        return pa.array(out, pa.string())

    return docs.withColumn(text, arrow_column(run, "string", text))

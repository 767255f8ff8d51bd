"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

A lexicon is learned from labelled rows: whole words, and stems (every word that
begins with one counts), that stand in toxic texts and not (or not as often) in
clean ones, taken by how many toxic texts they explain that no earlier term does.  The lexicon is
a trie.  A word is looked up by an automaton whose states are sets of (trie
node, edits so far): the intersection of the word's Levenshtein automaton with
the trie, made state by state as words need it.  So misspelled terms are found
in one walk over the word's characters, whatever the lexicon's size; short
terms are only found as they are.

A hit is worth its weight, and that of a whole word as it is times its context's
probability of abuse rather than quotation.  The weight is the log ratio of how often toxic and clean words are such hits: of the
term as it is, or misspelled by one or two edits (where no labelled text has such
forms: half of the term's weight an edit).  The context is judged by naive Bayes over
the words around it and over quotation marks, learned from such hits in toxic and in clean
texts; where either class has fewer than ``FEW`` of them, context is neutral.  Logistic
regression on the sum of a text's hits, alone and for its length, gives the score.

The lexicon and the curve are fitted on a bounded sample of labelled rows
(``SAMPLE`` rows of the smallest id hashes, ``SAMPLE_BYTES`` of text, whole texts);
weights and context use every labelled row.  Scoring reads every whole text.

Cases: null and empty texts have no hits and the score of none; labels that are
not 0 or 1, ids that are null and labelled ids without a document are not learned
from; several labels of an id are each a row; without labelled rows of both
classes every score is the share of label 1 (0.5 without rows)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affect.llm.common import arrow_column, fresh, strings, written
from affect.llm.quality import held_out

SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
FOLDS = 5
THRESHOLD = 0.5
#: Words on either side of a hit that are its context; hits that a context word needs, and that texts of either class need; context words at most.
WINDOW, FEW, CONTEXTS = 5, 20, 100_000
#: Shortest word and stem of a lexicon, longest stem, terms at most.
SHORTEST, STEM, LONGEST_STEM, TERMS = 3, 4, 10, 2000
#: How often a text may need a term; share of such texts that must be toxic; how unlikely their number must be by chance among all terms tried; how many there must be.
TIMES, PURE, CHANCE, EXPLAINED = (1, 2, 3), 0.75, 0.01, 3
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‹›¡¿…–—"
QUOTES = set("\"“”„«»‹›‘’")
PARTS = re.compile(r"[^\w*@$!'’-]+")
HITS = "struct<words: long, hits: array<struct<term: int, edits: int, context: array<string>>>>"


def edits_allowed(term: str, stem: bool) -> int:
    """How many edits a misspelled form of a term may have: by its length (a stem's tells less)."""
    n = len(term) - 2 * stem
    return 0 if n < 5 else 1 if n < 9 else 2


def bare(word: str) -> str:
    return word.strip(EDGES)


class Lexicon:
    """Trie of terms, and the automaton that finds a word's nearest term in it.  Terms are (text, is a stem)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # term, is a stem, edits allowed
        self.most = [0]  # edits that some term below allows
        for i, (t, stem) in enumerate(terms):
            node, k = 0, edits_allowed(t, stem)
            for c in t:
                self.most[node] = max(self.most[node], k)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], k)
            self.ends[node].append((i, stem, k))
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []  # best (edits, term) if the word ends here
        self.open: list[tuple[int, int] | None] = []  # best (edits, stem) reached here
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The number of the set of (node, least edits), with the nodes that leaving out characters of a term reaches."""
        todo = sorted(edits)
        for node in todo:
            e = edits[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < edits.get(child, 99):
                    edits[child] = e
                    todo.append(child)
        key = tuple(sorted(edits.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, i, stem) for node, e in key for i, stem, k in self.ends[node] if e <= k]
            self.whole.append(min(((e, i) for e, i, stem in ends), default=None))
            self.open.append(min(((e, i) for e, i, stem in ends if stem), default=None))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state]:
            for d, child in self.children[node].items():
                cost = e + (c != d)
                if cost <= self.most[child] and cost < reached.get(child, 99):
                    reached[child] = cost
            if e < self.most[node] and e + 1 < reached.get(node, 99):  # a character too many
                reached[node] = e + 1
        n = self.steps[state][c] = self._state(reached) if reached else -1
        return n

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the term nearest to the word, if one is near enough."""
        if len(self.sets) > 200_000:
            self._reset()
        state, best = self.start, self.open[self.start]
        for c in word:
            n = self.steps[state].get(c)
            state = self._step(state, c) if n is None else n
            if state < 0:
                return best
            found = self.open[state]
            if found and (best is None or found < best):
                best = found
        found = self.whole[state]
        return min(found, best) if found and best else found or best


class Finder(dict):
    """What each word of a text is a hit of, remembered (up to ``KEPT`` words)."""

    KEPT = 500_000

    def __init__(self, terms: list[tuple[str, bool]]):
        super().__init__()
        self.lexicon = Lexicon(terms)

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) > self.KEPT:
            self.clear()
        plain = bare(word)
        found = self.lexicon.nearest(plain) if len(plain) >= SHORTEST else None
        if found is None and plain and PARTS.search(plain):
            found = min((f for p in PARTS.split(plain) if len(p) >= SHORTEST and (f := self.lexicon.nearest(bare(p)))), default=None)
        self[word] = found
        return found

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, list[str]]]]:
        """Number of words, and (term, edits, context) of every one that is a hit."""
        words = text.lower().split()
        return len(words), [(f[1], f[0], context(words, i)) for i, f in enumerate(map(self.__getitem__, words)) if f]


def context(words: list[str], i: int, window: int = WINDOW) -> list[str]:
    """The distinct words around ``words[i]``, and ``"`` if it stands between quotation marks."""
    before, after = words[max(0, i - window):i], words[i + 1:i + 1 + window]
    out = {bare(w) for w in before + after} - {""}
    if (_opens(before) or words[i][0] in QUOTES) and (_closes(after) or words[i].rstrip(".,;:!?")[-1:] in QUOTES):
        out.add('"')
    return sorted(out)


def _opens(words: list[str]) -> bool:
    """The last quotation mark of the words opens a quotation."""
    return next((w[0] in QUOTES for w in reversed(words) if QUOTES & set(w)), False)


def _closes(words: list[str]) -> bool:
    """The first quotation mark of the words closes one."""
    return next((w.rstrip(".,;:!?")[-1:] in QUOTES for w in words if QUOTES & set(w)), False)


def _keys(text: str, before: dict[tuple, set[str]] | None = None) -> Counter:
    """How often the text has each word, and each stem of words; ``before`` collects the words that stand before them."""
    out: Counter = Counter()
    words = text.lower().split()
    for x, n in Counter(words).items():
        w = bare(x)
        if len(w) >= SHORTEST:
            out[w, False] += n
            for size in range(STEM, min(len(w), LONGEST_STEM + 1)):
                out[w[:size], True] += n
    if before is not None:
        for x, y in zip(["", *words], words):
            w = bare(y)
            if len(w) >= SHORTEST:
                before[w, False].add(x)
                for size in range(STEM, min(len(w), LONGEST_STEM + 1)):
                    before[w[:size], True].add(x)
    return out


def learn_terms(texts: list[str], labels: list[int]) -> list[tuple[str, bool]]:
    """Words and stems (True) that mark toxic texts, best first.

    A term explains the texts that have it ``m`` times or more, where ``m`` (1 to 3) is the
    least of which ``PURE`` of the texts are toxic: a stem may begin ordinary words here and
    there.  Its evidence is their number, or that of the different words before it if that
    is less: copies of one text are no evidence of their own."""
    pairs = sorted(set(zip(texts, labels)))
    before: dict[tuple, set[str]] = defaultdict(set)
    toxic = [_keys(t, before) for t, y in pairs if y]
    held: dict[tuple, list[int]] = defaultdict(lambda: [0] * len(TIMES))
    for keys in toxic:
        for k, n in keys.items():
            for j, m in enumerate(TIMES):
                held[k][j] += n >= m
    held = {k: c for k, c in held.items() if min(c[0], len(before[k])) >= EXPLAINED}
    clean: dict[tuple, list[int]] = {k: [0] * len(TIMES) for k in held}
    n0 = 0
    for t, y in pairs:
        if not y:
            n0 += 1
            for k, n in _keys(t).items():
                if k in held:
                    for j, m in enumerate(TIMES):
                        clean[k][j] += n >= m
    fit = {(k, j) for k, c in held.items() for j in range(len(TIMES)) if c[j] >= EXPLAINED and c[j] >= PURE * (c[j] + clean[k][j])}
    left = [{(k, j) for k, n in keys.items() for j, m in enumerate(TIMES) if n >= m and (k, j) in fit} for keys in toxic]
    unlikely = math.log(max(1, len(held)) / CHANCE)

    def beside(x: tuple) -> bool:
        """One of the two begins the other and a stem is in it."""
        (t, stem), _ = x
        return any((s and t.startswith(u)) or (stem and u.startswith(t)) or t == u for u, s in chosen)

    def order(x: tuple, n: int) -> tuple:
        """Of equal ones the fewest times, a word before a stem, the longest, which says most."""
        (t, stem), j = x
        return n - clean[t, stem][j], -j, not stem, len(t), t

    explained = Counter(x for xs in left for x in xs)
    chosen: list[tuple[str, bool]] = []
    open_texts = len(toxic)
    while explained and len(chosen) < TERMS:
        best = max(explained, key=lambda x: order(x, explained[x]))
        n = min(explained[best], len(before[best[0]]))
        if n < EXPLAINED or n * -math.log(open_texts / (open_texts + n0)) < unlikely:
            break
        chosen.append(best[0])
        for xs in left:
            if best in xs:
                explained.subtract(xs)
                xs.clear()
                open_texts -= 1
        explained = +explained
    # terms that stand beside chosen ones explain no further text of the sample but are as sure
    p = len(toxic) / max(1, len(toxic) + n0)
    for x in sorted(fit, key=lambda x: order(x, held[x[0]][x[1]]), reverse=True):
        if len(chosen) < TERMS and p and min(held[x[0]][x[1]], len(before[x[0]])) * -math.log(p) >= unlikely and not beside(x):
            chosen.append(x[0])
    return list(dict.fromkeys(chosen))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients (the last is the constant) of the logistic regression of y on the columns of x, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -3, 3)
    return w


@dataclass
class Model:
    """Terms, weights of (term, edits), log ratios of context words with their prior, and the curve."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    prior: float = 0.0
    ratios: dict[str, float] = field(default_factory=dict)
    contextual: bool = False
    curve: np.ndarray | None = None
    constant: float | None = None

    def abuse(self, around: list[str]) -> float:
        """Probability that a hit in this context is abuse, not quotation."""
        if not self.contextual:
            return 1.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + sum(self.ratios.get(w, 0.0) for w in around)))))

    def weight(self, term: int, edits: int) -> float:
        """Misspelled forms that no labelled text has weigh half of the term's weight for each edit."""
        w = self.weights.get((term, edits))
        return max(0.0, self.weights.get((term, 0), 0.0) * 0.5 ** edits if w is None else w)

    def facts(self, n: int, hits: list[tuple[int, int, list[str]]]) -> list[float]:
        """What the curve sees of a text of n words: its hits' weights, and how much they are for its length."""
        total = sum(self.weight(i, e) * (1.0 if e or self.terms[i][1] else self.abuse(around)) for i, e, around in hits)
        return [math.log1p(total), math.sqrt(total), math.log1p(n) * (total > 0), 10 * total / (n + 20)]

    def score(self, n: int, hits: list[tuple[int, int, list[str]]]) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(np.array([*self.facts(n, hits), 1.0]) @ self.curve, -30, 30))))


def find(docs: DataFrame, terms: list[tuple[str, bool]], text: str, into: str) -> DataFrame:
    """``docs`` with number of words and hits of every text in ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kept: list[Finder] = []

    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Finder(shared.value))
        out = []
        for t in strings(texts):
            n, hits = kept[0].hits(t)
            out.append({"words": n, "hits": [{"term": i, "edits": e, "context": around} for i, e, around in hits]})
        hit = pa.struct([("term", pa.int32()), ("edits", pa.int32()), ("context", pa.list_(pa.string()))])
        return pa.array(out, pa.struct([("words", pa.int64()), ("hits", pa.list_(hit))]))

    return docs.withColumn(into, arrow_column(run, HITS, text))


def _sampled(docs: DataFrame, known: DataFrame, sample: int, most: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``sample`` rows and ``most`` bytes: first keys and lengths, then the texts of what fits."""
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = (docs.join(F.broadcast(chosen), "id").select("id", "label", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))
            .orderBy(F.xxhash64("id"), "id", "label", "h").limit(sample).collect())
    left, fits = most, []
    for r in rows:
        if r["n"] <= left:
            left -= r["n"]
            fits.append(r)
    wanted = docs.sparkSession.createDataFrame([(r["id"], r["h"]) for r in fits], known.select("id").schema.add("h", "long")).distinct()
    found = (docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "h"])
             .dropDuplicates(["id", "h"]).select("id", "h", "text").collect())
    texts = {(r["id"], r["h"]): r["text"] for r in found}
    return [texts[r["id"], r["h"]] for r in fits], [r["label"] for r in fits]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, folds: int = FOLDS) -> Model:
    """A model of the labels outside the held-out fold."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id, folds))
    known = known.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    texts, y = _sampled(docs, known, sample, sample_bytes)
    if not y or min(y) == max(y):
        return Model(constant=sum(y) / len(y) if y else 0.5)
    model = Model(learn_terms(texts, y))
    if not model.terms:
        return Model(constant=sum(y) / len(y))
    found = written(find(docs, model.terms, "text", "found").select("id", "found.*").join(known, "id").drop("id"), "toxic-hits")
    words = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.sum("words").alias("n")).collect()}
    hits = found.where(F.size("hits") > 0).select("label", F.explode("hits").alias("hit")).select("label", "hit.*")
    counts: dict[tuple[int, int], list[int]] = {(i, 0): [0, 0] for i in range(len(model.terms))}
    for r in hits.groupBy("term", "edits", "label").count().collect():  # terms x edits x 2 rows
        counts.setdefault((r["term"], r["edits"]), [0, 0])[r["label"]] += r["count"]
    half = 0.5 / max(1, words.get(0, 0))
    for (term, edits), (n0, n1) in sorted(counts.items(), key=lambda c: c[0][1]):
        before = math.exp(model.weights[term, 0] * 0.5 ** edits) if edits else 1.0
        model.weights[term, edits] = math.log((n1 / max(1, words.get(1, 0)) + half * before) / (n0 / max(1, words.get(0, 0)) + half))
    whole = [i for i, (_, stem) in enumerate(model.terms) if not stem]  # stems and misspellings also meet ordinary words, which are no quotations
    total = [sum(counts[i, 0][y] for i in whole) for y in (0, 1)]
    if min(total) >= FEW:
        model.contextual, model.prior = True, math.log(total[1] / total[0])
        n1, n0 = F.sum("label"), F.sum(1 - F.col("label"))
        around = (hits.where((F.col("edits") == 0) & F.col("term").isin(whole)).select("label", F.explode("context").alias("word")).groupBy("word").agg(n1.alias("n1"), n0.alias("n0"))
                  .where(F.col("n1") + F.col("n0") >= FEW).orderBy(F.desc(F.col("n1") + F.col("n0")), "word").limit(CONTEXTS))
        for r in around.collect():
            model.ratios[r["word"]] = math.log((r["n1"] + 1) / (total[1] + 2)) - math.log((r["n0"] + 1) / (total[0] + 2))
    finder = Finder(model.terms)
    model.curve = curve(np.array([model.facts(*finder.hits(t)) for t in texts]), np.array(y, float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of every text, 0 to 1, in ``into`` (made longer if taken).  No shuffle; the lexicon is broadcast (``TERMS`` at most)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: list[Finder] = []

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        if not kept:
            kept.append(Finder(m.terms))
        return pa.array([m.score(*kept[0].hits(t)) for t in strings(texts)], pa.float64())

    return docs.withColumn(fresh(into, docs), arrow_column(run, "double", text))

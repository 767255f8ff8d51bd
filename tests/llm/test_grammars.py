"""Inference of the automata of op8: a known source, the mass of states, and a plain version of the merges."""

from __future__ import annotations

import math
import random

import pytest

from affect.llm import secrets


def two_state_source(r, n):
    """a: 0.7 stays, b: 0.2 goes over, end 0.1; over there b: 0.6 stays, a: 0.3 goes back, end 0.1."""
    out = []
    for _ in range(n):
        s, state = "", 0
        while (x := r.random()) >= 0.1:
            c = ("a" if x < 0.8 else "b") if state == 0 else ("b" if x < 0.7 else "a")
            s, state = s + c, int(c == "b")
        out.append(s)
    return out


def test_a_two_state_source_is_recovered():
    automaton = secrets.infer(two_state_source(random.Random(1), 4000))
    assert len(automaton) == 2
    (end0, go0, _), (end1, go1, _) = automaton
    want = [(end0, 0.1), (go0["a"][0], 0.7), (go0["b"][0], 0.2), (end1, 0.1), (go1["b"][0], 0.6), (go1["a"][0], 0.3)]
    assert all(abs(math.exp(x) - p) < 0.02 for x, p in want)
    assert [go0["a"][1], go0["b"][1], go1["b"][1], go1["a"][1]] == [0, 1, 1, 0]


def test_edges_have_their_own_frequencies():
    r = random.Random(2)
    values = ["".join(r.choices("ab", (9, 1), k=20)) for _ in range(1000)]
    automaton = secrets.infer(values)
    share = sum(v.count("a") for v in values) / 20_000
    for _, go, _ in automaton:  # a state that has seen much goes on as the source does
        if len(go) == 2:
            assert abs(math.exp(go["a"][0]) - share) < 0.08


def sources():
    r = random.Random(3)
    yield two_state_source(r, 60)
    yield ["".join(r.choices("abc", k=r.randint(0, 6))) for _ in range(80)]
    yield [f"ab{r.choice('xy')}-{r.choice(['01', '02', '11'])}" for _ in range(50)]
    yield ["", "", "a"]
    yield ["key" + "".join(r.choices("01", k=8)) for _ in range(40)] + ["é日"] * 9


def plain_infer(values, alpha):
    """States are sets of prefixes; merging two joins what the same strings lead to from both."""
    prefixes = {v[:i] for v in values for i in range(len(v) + 1)}
    count = {p: sum(v.startswith(p) for v in values) for p in prefixes}
    block = {p: frozenset([p]) for p in prefixes}

    def stats(b):
        chars = sorted({q[len(p):] for p in b for q in prefixes if len(q) == len(p) + 1 and q.startswith(p)})
        return sum(count[p] for p in b), sum(values.count(p) for p in b), {c: sum(count.get(p + c, 0) for p in b) for c in chars}

    def after(b, c):
        return next(block[p + c] for p in b if p + c in prefixes)

    def differ(a, n, b, m):
        return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (n ** -0.5 + m ** -0.5)

    def agree(x, y):
        (n, e, go), (m, f, to) = stats(x), stats(y)
        if differ(e, n, f, m) or any(differ(go.get(c, 0), n, to.get(c, 0), m) for c in {*go, *to}):
            return False
        return all(agree(after(x, c), after(y, c)) for c in go if c in to and after(x, c) != after(y, c))

    red = [""]
    while True:
        found = None
        for p in red:
            for c in stats(block[p])[2]:
                if not any(after(block[p], c) == block[q] for q in red):
                    found = after(block[p], c)
                    break
            if found:
                break
        if not found:
            break
        for q in red:
            if agree(block[q], found):
                todo = [(block[q], found)]
                while todo:
                    x, y = (block[next(iter(b))] for b in todo.pop())
                    if x != y:
                        for p in x | y:
                            block[p] = x | y
                        for c in stats(x)[2]:
                            if c in stats(y)[2]:
                                todo.append((after(x, c), after(y, c)))
                break
        else:
            red.append(min(found, key=len))
    out = []
    for p in red:
        n, e, go = stats(block[p])
        out.append((math.log((e + 1e-3) / (n + 1)), {c: (math.log(t / (n + 1)), next(i for i, q in enumerate(red) if block[q] == after(block[p], c))) for c, t in go.items()},
                    math.log(0.999 / (n + 1) / (68 - len(go)))))
    return out


@pytest.mark.parametrize("values", list(sources()))
def test_merges_agree_with_a_plain_version(values):
    for alpha in (0.05, 0.5, 0.9):
        got, want = secrets.infer(values, alpha), plain_infer(values, alpha)
        assert len(got) == len(want)
        for (e, go, left), (f, to, rest) in zip(got, want):
            assert abs(e - f) < 1e-12 and abs(left - rest) < 1e-12 and {c: t for c, (_, t) in go.items()} == {c: t for c, (_, t) in to.items()}
            assert all(abs(go[c][0] - to[c][0]) < 1e-12 for c in go)
            mass = math.exp(e) + sum(math.exp(x) for x, _ in go.values())
            assert 0.5 <= mass < 1 and abs(mass + (68 - len(go)) * math.exp(left) - 1) < 1e-9  # with what is left for the unseen, all of it


def test_format_spans_where_values_are_many(spark):
    """Credentials of one format, labelled in some texts and bare in others, beside ordinary words and numbers of the same length."""
    r = random.Random(4)

    def key():
        return "".join(r.choices("BCDFGH", k=4)) + "-" + "".join(r.choices("0123456789", k=8)) + "-" + "".join(r.choices("xyz", k=6))

    def plain():
        return r.choice(["".join(r.choices("aeiourstln", k=r.randint(12, 18))), "".join(r.choices("0123456789", k=14)), "".join(r.choices("AEIOURSTLN", k=13))])

    labelled, bare, words = [key() for _ in range(300)], [key() for _ in range(100)], [plain() for _ in range(900)]
    texts = [f"token={k} then {plain()} and {plain()}" for k in labelled] + [f"see {k} or {w}" for k, w in zip(bare, words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = secrets.scan(docs, secrets.learn(docs))
    got = {x.doc_id: [(s.kind, x.text[s.start:s.end]) for s in x.secrets] for x in found.collect()}
    assert all(got[300 + i] == [("format", k)] for i, k in enumerate(bare))
    assert all([k for k, _ in got[i]] == ["assign"] for i in range(300))

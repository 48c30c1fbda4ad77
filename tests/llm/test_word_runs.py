"""Runs against a version that tries every period of every text, and the grammar against its text."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kontor.llm import queries, word_runs


def plain_runs(words):
    """(start, length, period) of all runs: every period, every maximal stretch, least periods only."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            stop = at
            while stop + q < len(words) and words[stop] == words[stop + q]:
                stop += 1
            if stop + q - at >= max(6, 4 * q):
                found.setdefault((at, stop + q - at), q)
            at = stop + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def runs_of(texts):
    edges = np.cumsum([0, *map(len, texts)])
    start, end, period = word_runs.periodic_runs(np.array([x for t in texts for x in t], np.int64), edges)
    owner = np.searchsorted(edges, start, side="right") - 1
    result = [[] for _ in texts]
    for t, a, b, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist()):
        result[t].append((a - int(edges[t]), b - a, q))
    return result


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.integers(0, 2), max_size=80),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 90), st.lists(st.integers(0, 3), max_size=9)).map(
        lambda x: x[2] + (x[0] * 90)[:x[1]] + x[2])), max_size=4))
def test_any_words(texts):
    assert runs_of(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_nested_and_long_periods(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        inner = [rng.randint(0, 3) for _ in range(rng.randint(1, 5))] * rng.randint(1, 8)
        block = (inner + [rng.randint(0, 9) for _ in range(rng.randint(0, 4))]) * rng.randint(1, 7)
        texts.append([rng.randint(0, 9) for _ in range(rng.randint(0, 30))] + block + block[:rng.randint(0, 40)] + [rng.randint(0, 9)] * rng.randint(0, 9))
    fibonacci = [0], [0, 1]
    for _ in range(11):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    texts += [fibonacci[1], [7] * 500, [1, 2] * 300 + [1], [int(b) for b in bin(int("1" * 60, 7))[2:]], []]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_small_steps(monkeypatch):
    monkeypatch.setattr(word_runs, "STEP_PERIODS", 7)
    texts = [[1, 2, 3] * 12 + [4], [5] * 40, list(range(30)) * 5]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_collision_is_noticed(monkeypatch):
    """Hashes that tell nothing apart do not pass; the second bases are tried."""
    texts = [list(range(40)) + [1, 2] * 10, [3] * 9]
    monkeypatch.setattr(word_runs, "BASES", ((0, 0), word_runs.BASES[0]))
    assert runs_of(texts) == [plain_runs(t) for t in texts]
    monkeypatch.setattr(word_runs, "BASES", ((0, 0),))
    with pytest.raises(ArithmeticError):
        runs_of(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=4))
def test_grammar(texts):
    """Equal symbols derive equal words, and at the end no pair of symbols of a text is left twice."""
    edges = np.cumsum([0, *map(len, texts)])
    words = np.array([x for t in texts for x in t], np.int64)
    grammar = word_runs.re_pair(words, edges)
    at, rules = 0, grammar.rules
    spans = {}
    for number, (a, m, b, n) in enumerate(zip(*rules, grammar.counts)):
        assert a < m < b
        for place in grammar.places[at:at + n]:
            assert words[place:place + b - a].tolist() == words[a:b].tolist()
            spans.setdefault(int(place), []).append((int(b - a), number))
        at += n
    for t, text in enumerate(texts):
        rest, place, seen, last = [], edges[t], {}, -9
        while place < edges[t + 1]:
            size, symbol = max(spans.get(int(place), [(1, ("word", int(words[place])))]), key=lambda x: x[0])
            rest.append(symbol)
            place += size
        for k, pair in enumerate(zip(rest, rest[1:])):
            assert k - seen.get(pair, k - 1) <= 1, "only overlapping repeats remain"
            seen.setdefault(pair, k)


def plain_rows(doc_id, text, plant):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(((-size, a, q) for a, size, q in runs), default=None)
    return (doc_id, len(runs), *((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{a},{size},{q}\n" for a, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


@pytest.mark.parametrize("plant", [False, True])
def test_documents(spark, plant):
    rng = random.Random(2)
    texts = [None, "", " \n", "a", "b b b b b", "b b b b b b", "x y " * 40 + "z", "naïve 日本 " * 9, "same same x", "same same x", "a " * 3_000]
    texts += [" ".join(rng.choice(["a", "b", "c", "d\t"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    rows = [(k or None, x, "old", "old") for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, key string").repartition(3)
    found = queries.run_rows(queries.planted(docs) if plant else docs)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted((plain_rows(k, x, plant) for k, x, *_ in rows), key=key)
    assert queries.run_rows(docs.limit(0)).collect() == []


def test_long_text_of_one_word_and_of_many(spark):
    rng = random.Random(8)
    many = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000)) + " " + "one two three " * 100_000
    docs = spark.createDataFrame([(1, "a " * 500_000), (2, many)], "doc_id long, text string")
    got = {r.doc_id: r.runs for r in word_runs.word_runs(docs).collect()}
    assert [tuple(r) for r in got[1]] == [(0, 500_000, 1)]
    assert (200_000, 300_000, 3) in [tuple(r) for r in got[2]]

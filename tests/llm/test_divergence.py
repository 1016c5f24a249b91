"""The audit against sums with Python integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lumitie.llm import divergence
from lumitie.sources.stage import Stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    n, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        n.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), k in docs.items() if x == lang and k >= 3)
        sources = sorted(s for x, s in groups if x == lang)
        of = {s: [n[lang, s, t] for t in kept] for s in sources}

        def p(counts):
            return [1 + 10**9 * (c + 1) // (sum(counts) + len(kept)) for c in counts]

        whole = p([sum(of[s][i] for s in sources) for i in range(len(kept))])
        prob = {s: p(of[s]) for s in sources}
        for s in sources:
            pairs = [(sum((x - y) ** 2 // y for x, y in zip(prob[s], prob[o])), o) for o in sources if o != s]
            terms = [((x - y) ** 2 // y, t) for x, y, t, c in zip(prob[s], whole, kept, of[s]) if c and x > y]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    return sorted(tuple(r) for r in divergence.audit(df.repartition(4), Stage(spark, "t"), **kw).collect())


@pytest.fixture()
def rows():
    rng = random.Random(2)
    words = ["Sol", "mare", "ÜBER", "über", "日本", "a1b", "x_y", "Z"] + [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefg"]
    out = [(rng.choice(["en", "de", None]), f"s{rng.randrange(19)}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for _ in range(300)]
    out += [("en", "empty", None), ("en", "empty", ""), ("fr", "a", None), ("fr", "b", "une fois"), ("fr", None, "!!"), (None, None, None)]
    return out + [("en", "hot", "the same text Again again")] * 150


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_TERMS", 11)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(divergence, "HELD_TERMS", 40)
    assert run(spark, rows) == brute(rows)


def test_one_shard_and_few_ranks(spark, rows):
    assert run(spark, rows, top=5) == brute(rows, 5)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", "a", "x")]) == []


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 300))) for _ in range(2))
        i, j = divergence.gallop(a, b, int(rng.integers(1, 70)))
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_probabilities_of_large_counts():
    for x, total, v in ((10**12, 10**15, 10**6), (0, 1, 1), (5 * 10**14, 5 * 10**14, 0), (2, 9 * 10**14, 7)):
        assert divergence.probability(np.array([x]), total, v)[0] == 1 + 10**9 * (x + 1) // (total + v)

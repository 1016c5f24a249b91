import random

import pytest

from lumitie.llm import decontaminate as D
from lumitie.llm.shingle import WORDS


def grams(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, t=0.8):
    out = set()
    for d, text in docs:
        for i, item in items:
            k = min(WORDS, len((item or "").split()))
            if k and (q := grams(item, k)) and len(q & grams(text, k)) >= t * len(q):
                out.add((d, i, len(q & grams(text, k)), len(q)))
    return out


def found(spark, stage, docs, items):
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, containment string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in D.contained_items(d, i, stage).collect())


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


@pytest.mark.parametrize("block", [D.BLOCK_ITEMS, 7])
def test_equals_brute_force(spark, stage, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_ITEMS", block)
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.choice([1, 3, 4, 5, 6, 9, 17, 40, 64, 65, 130])))) for i in range(24)]
    docs = []
    for d in range(60):
        w = words(rng, rng.choice([0, 5, 30, 300, 6000]))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1].split()
            if len(item) > 20 and rng.random() < 0.6:
                item[rng.randrange(len(item))] = "CHANGED"
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((d, " ".join(w)))
    assert found(spark, stage, docs, items) == sorted(brute(docs, items))


def test_edge_rows(spark, stage):
    docs = [(1, "One two three  FOUR five\nsix"), (1, "One two three  FOUR five\nsix"), (2, None), (3, ""), (None, "one two three four five six seven"), (4, "one two")]
    items = [(1, "one two three four five six"), (2, None), (3, "  "), (4, "two"), (None, "one two")]
    got = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), stage)
    rows = sorted(((r.doc_id or -1, r.item_id or -1) for r in got.collect()))
    assert rows == sorted([(1, 1), (1, 4), (1, -1)] * 2 + [(-1, 1), (-1, 4), (-1, -1), (4, 4), (4, -1)])
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:1], "item_id long, text string")
    assert D.contained_items(d.limit(0), i, stage).count() == 0 and D.contained_items(d, i.limit(0), stage).count() == 0
    assert sorted(r.doc_id for r in D.without_contaminated(d, i).collect()) == [2, 3, 4]
    assert D.without_contaminated(d, i.limit(0)).count() == 6

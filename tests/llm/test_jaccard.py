import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumitie.llm import jaccard as J
from lumitie.llm.shingle import WORDS


def grams(text):
    w = (text or "").lower().split()
    k = min(WORDS, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links, class_size) per row, sorted."""
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            todo, comp = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in comp:
                        comp.add(j)
                        todo.append(j)
            for j in comp:
                seen[j] = comp
        ids = [rows[j][0] for j in seen[i] if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i]), len(seen[i])))
    return sorted(out, key=str)


def made(rng, n):
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not texts:
            w = [f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 4, 6, 40, 200]))]
        else:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(900)}"
        texts.append(" ".join(w))
        rows.append((i, texts[-1] if rng.random() < 0.9 else texts[-1].upper().replace(" ", "\n")))
    return rows


def got(spark, stage, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    return sorted((tuple(r) for r in J.join_report(docs, stage).collect()), key=str)


def test_equals_brute_force(spark, stage):
    rng = random.Random(8)
    rows = made(rng, 260)
    base = [f"b{i}" for i in range(120)]
    for i in range(300, 420):  # a group of near copies, larger than a block below
        w = list(base)
        w[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(w)))
    assert got(spark, stage, rows) == brute(rows)


def test_small_blocks_and_edge_rows(spark, stage, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(J, "CLUSTER_BLOCK", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"y{i % 50}"
        rows.append((i, " ".join(w)))
    rows += [(1, rows[1][1]), (None, rows[2][1]), (None, "a b c"), (None, "a b c"), (70, None), (71, ""), (72, " \n"), (70, None), (73, "z " * 9000)]
    assert got(spark, stage, rows) == brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in J.one_of_each_class(docs, stage).collect()]
    assert len(kept) == len({c for _, c, _, _ in brute(rows) if c is not None} | {"abc"}) + 1
    assert {k[0] for k in kept} == {0, None, 70, 71, 72, 73} or {k[0] for k in kept} >= {70, 71, 72, 73, None}
    assert J.join_report(docs.limit(0), stage).count() == 0 and J.one_of_each_class(docs.limit(0), stage).count() == 0


def test_keeping_one(spark, stage):
    rows = made(random.Random(10), 150) + [(3, "same same words here now"), (3, "same same words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in J.one_of_each_class(docs, stage).collect())
    want = brute(rows)
    assert len(kept) == len({c for _, c, _, _ in want}) + (len({w for w in want if w[0] == 3 == w[1]}) > 1)
    assert J.one_of_each_class(docs, stage).columns == docs.columns


def test_pruning_rule():
    assert J.least_matches(16) < J.least_matches(32) < J.least_matches(96) <= 0.8 * 96
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (300, 96), dtype=np.uint8)
    b = np.where(rng.random((300, 96)) < 0.8, a, rng.integers(0, 256, (300, 96), dtype=np.uint8))
    keep = J._compare(a, b)
    assert keep.diagonal().all() and keep.sum() == 300


def test_block_pairs_of_one_group_are_spread(spark):
    n, conf = 40, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        blocks = spark.createDataFrame([(7, i, n, i) for i in range(n)] + [(8, 0, 1, 100)], "band long, block int, blocks int, m int")
        rows = J._block_pairs(blocks, "band").where("b is not null").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.a, r.b) for r in rows) == [(i, j) for i in range(n) for j in range(i + 1, n)]
    tasks = Counter(r.task for r in rows)
    assert len(tasks) > 5 and max(tasks.values()) < len(rows) / 3

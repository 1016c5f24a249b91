"""Repeated strings against brute force over all starts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumitie.llm import parsing
from lumitie.sources.stage import Stage

L = parsing.LENGTH


def brute(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting every string of L bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - L + 1):
            if seen[d[i:i + L]] > 1:
                gone[i:i + L] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, td string, n string")
    rows = {r["doc_id"]: r for r in parsing.report(docs.repartition(3), Stage(spark, "t")).collect()}
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in (rows[i] for i in range(len(texts)))]


def prose(rng, n):
    return " ".join(rng.choice(["sol", "mare", "tempus", "ünder", "lux", "ordo", "via", "nox", "日本"]) + str(rng.randrange(200)) for _ in range(n))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(parsing, "RANGE_ROWS", 7)
    rng = random.Random(5)
    shared, other = prose(rng, 200), prose(rng, 90)
    texts = [None, "", "a", shared, shared[:L - 1], prose(rng, 400), prose(rng, 3) + shared + prose(rng, 9), shared[50:700] + prose(rng, 60),
             prose(rng, 30) + other, other + prose(rng, 30), "a" * 1500, "ab" * 700, "abc" * 300 + prose(rng, 100), other, other,
             "\n" * 900, shared[100:100 + L], prose(rng, 20) + shared[200:200 + L] + prose(rng, 20), shared[300:700] + shared[310:720]]
    for k in range(40):  # strings around the limit, at every phase
        at = rng.randrange(0, 500)
        texts.append(prose(rng, rng.randrange(0, 12)) + shared[at:at + L - 3 + k % 9] + prose(rng, rng.randrange(0, 12)))
    assert run(spark, texts) == brute(texts)


def test_many_near_copies(spark):
    rng = random.Random(6)
    base = prose(rng, 500)
    texts = []
    for _ in range(60):
        words = base.split(" ")
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(40))
        texts.append(" ".join(words))
    assert run(spark, texts) == brute(texts)


def test_given_documents(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    assert run(spark, texts) == brute(texts)


def test_all_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert parsing.report(docs, Stage(spark, "t")).collect() == []
    assert run(spark, [None, ""]) == brute([None, ""])


@pytest.mark.parametrize("seed", range(30))
def test_every_start_has_the_anchor_its_string_gives_it(seed):
    """The anchor of a start depends on the string of L bytes alone."""
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + rng.integers(1, 5), 3000).astype(np.uint8) if seed % 3 else np.repeat(rng.integers(97, 120, 60), 50).astype(np.uint8)
    of = {i: at for at, first, last in parsing.anchors(data).tolist() for i in range(first, last + 1)}
    assert sorted(of) == list(range(len(data) - L + 1))
    for i in rng.integers(0, len(data) - L + 1, 200).tolist():
        alone = parsing.anchors(data[i:i + L])
        assert alone.tolist() == [[of[i] - i, 0, 0]] and of[i] - i <= parsing.REACH


def test_texts_parsed_together_have_the_anchors_of_each():
    rng = np.random.default_rng(3)
    kinds = [lambda n: rng.integers(97, 123, n), lambda n: np.full(n, 97), lambda n: rng.integers(97, 99, n), lambda n: np.repeat(rng.integers(97, 120, n // 40 + 1), 40)[:n]]
    for _ in range(60):
        texts = [kinds[rng.integers(0, 4)](int(rng.choice([0, 5, L - 1, L, L + 1, 700, 5000]))).astype(np.uint8) for _ in range(rng.integers(1, 9))]
        sizes = np.array([len(t) for t in texts])
        each = [parsing.anchors(t) + at for t, at in zip(texts, np.cumsum(sizes) - sizes)]
        assert np.array_equal(parsing.anchors(np.concatenate(texts), sizes), np.concatenate(each))


def test_a_task_parses_short_texts_together_and_long_ones_alone(monkeypatch):
    monkeypatch.setattr(parsing, "GROUP", 1000)
    texts = ["a" * 300, None, "b" * 600, "c" * 5000, "d" * 900, "e" * 200, *["f"] * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["td", "text"])
    got = [(piece.num_rows, data) for piece, data, _, _ in parsing._together([batch], 64)]
    assert [n for n, _ in got] == [3, 1, 1, 64, 64, 64, 9] and b"".join(d for _, d in got) == "".join(t or "" for t in texts).encode()


def test_runs_are_found_in_one_shuffle_of_the_anchors(spark):
    rows = [(b"x", at, at - 40, at, 1, 50 if at == 300 else at, at, at, 400 if at < 900 else 380) for at in range(50, 1500, 50)]
    anchor = spark.createDataFrame(rows, "td binary, at long, first long, last long, g long, q long, c1 long, c2 long, match int")
    staged = Stage(spark, "t").write(parsing.with_runs(anchor), "anchors")
    ends = parsing.ends_of_runs(staged)
    assert "Window" not in ends._jdf.queryExecution().optimizedPlan().toString()
    inside = {r["at"] for r in staged.where("inside").collect()}
    assert inside == set(range(100, 900, 50))
    assert {(r["first"], r["last"]) for r in ends.collect()} == {(10, 50), (260, 300)} | {(at - 40, at - 20) for at in range(900, 1500, 50)}


def test_common_prefix():
    assert [parsing._shared(a, b) for a, b in [(b"", b"x"), (b"ab", b"ab"), (b"abc", b"abd"), (b"abc", b"ab"), (b"\x00\x00", b"\x00\x01"), (b"xa", b"ya")]] == [0, 2, 2, 2, 1, 0]

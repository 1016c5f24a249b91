import random
from collections import defaultdict

import numpy as np

from lumitie.llm import chunks as C


def brute_ends(data):
    """Ends by the definition, one byte at a time."""
    n, hashes, h = len(data), [], 0
    for i in range(n):
        h = 0
        for j in range(max(0, i - C.WINDOW + 1), i + 1):
            h += int(C._GEAR[data[j]]) << (i - j)
        hashes.append(h & 0xFFFFFFFF)
    for i in range(n - 1):
        if data[i + 1] & 0xC0 == 0x80:
            hashes[i] = 0xFFFFFFFF
    big = 0xFFFFFFFF
    out = []
    for i in range(n):
        before = [hashes[k] if k >= 0 else big for k in range(i - C.REACH, i)]
        after = [hashes[k] if k < n else big for k in range(i + 1, i + 1 + C.REACH)]
        if hashes[i] < min(before) and hashes[i] <= min(after) and C.REACH <= i + 1 < n:
            out.append(i + 1)
    return [*out, n] if n else []


def text(rng, n):
    return " ".join("".join(rng.choice("abcdéfghiñ") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_ends_by_definition(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 5, 60, 300):
        data = text(rng, n).encode() if n else b""
        whole = C.chunk_ends(data).tolist()
        assert whole == brute_ends(data)
        with monkeypatch.context() as m:
            m.setattr(C, "PIECE", 97)
            assert C.chunk_ends(data).tolist() == whole
    assert C.chunk_ends(b"a" * 500).tolist()[-1] == 500


def test_insertions_shift_nothing():
    rng = random.Random(2)
    passage = text(rng, 400).encode()
    chunks = lambda d: {d[a:b] for a, b in zip([0, *C.chunk_ends(d)[:-1]], C.chunk_ends(d))}
    one, two = chunks(text(rng, 50).encode() + passage), chunks(text(rng, 31).encode() + b" x " + passage[:700] + b"INSERT" + passage[700:])
    assert sum(map(len, one & two)) > 0.8 * len(passage)


def brute(rows):
    """(doc_id, start, stop, first_doc_id, keep) of repeated passages."""
    docs = sorted({(i, t) for i, t in rows if t}, key=lambda x: (x[0] is not None, x[0] or 0))
    where = defaultdict(list)
    for d, (i, t) in enumerate(docs):
        data, ends = t.encode(), brute_ends(t.encode())
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            where[data[a:b]].append((d, k, a, b))
    marked = defaultdict(list)
    for places in where.values():
        if len(places) > 1:
            for p in places:
                marked[p[0]].append((*p[1:], p == min(places), docs[min(places)[0]][0]))
    out = []
    for d, chunks in marked.items():
        run = []
        for c in [*sorted(chunks), None]:
            if run and (c is None or c[0] != run[-1][0] + 1):
                if run[-1][2] - run[0][1] >= C.LEAST_BYTES:
                    out.append((docs[d][0], run[0][1], run[-1][2], run[0][4], all(r[3] for r in run)))
                run = []
            run.append(c)
    return sorted(out, key=str)


def test_equals_brute_force(spark, stage):
    rng = random.Random(3)
    passages = [text(rng, 60) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [text(rng, rng.randrange(1, 40))] + [rng.choice(passages) for _ in range(rng.randrange(2))] + [text(rng, 20)]
        rows.append((i, " ".join(parts)))
    rows += [(40, rows[3][1]), (3, rows[3][1]), (41, None), (42, ""), (None, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = sorted(((r.doc_id, r.start, r.stop, r.first_doc_id, r.keep) for r in C.report(docs, stage).collect()), key=str)
    assert got == brute(rows)
    assert {r[0] for r in got} >= {40, None}
    cut = {r.doc_id: r.text for r in C.without_repeats(docs, stage).collect()}
    assert cut[41] is None and cut[42] == "" and len(cut[40]) < 100 < len(rows[3][1])
    assert C.report(docs.limit(0), stage).count() == 0


def test_planted_passages_are_caught(spark, stage):
    rng = random.Random(4)
    passage = " ".join(text(rng, 1)[:6] for _ in range(55))
    rows = [(i, f"{text(rng, 80)} {passage} {text(rng, 80)}" if i % 4 == 0 else text(rng, 160)) for i in range(80)]
    got = {r.doc_id for r in C.report(spark.createDataFrame(rows, "doc_id long, text string"), stage).collect()}
    assert got == {i for i in range(80) if i % 4 == 0}


def test_every_repeated_chunk_stays_at_its_first_place(spark, stage):
    rng = random.Random(5)
    one, two, own = text(rng, 60), text(rng, 60), text(rng, 50)
    copy = f"{own} {one} {two} {text(rng, 30)}"
    rows = [(1, f"{text(rng, 30)} {one} {text(rng, 20)}"), (2, f"{text(rng, 30)} {two} {text(rng, 20)}"), (5, copy), (9, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = {i: [t.encode()[a:b] for a, b in zip([0, *brute_ends(t.encode())], brute_ends(t.encode()))] for i, t in rows}
    first = {}
    for i in sorted(pieces):
        for chunk in pieces[i]:
            first.setdefault(chunk, i)
    shared = set(pieces[1]) & set(pieces[5]) | set(pieces[2]) & set(pieces[5])
    assert {first[c] for c in shared} == {1, 2} and len(set(pieces[5]) - shared) > 10
    left = {r.doc_id: r.text for r in C.without_repeats(docs, stage).collect()}
    assert left == {i: b"".join(c for c in pieces[i] if first[c] == i).decode() for i in pieces}
    assert left[5] and not left[9]
    got = C.report(docs, stage).collect()
    assert {(r.first_doc_id, r.keep) for r in got if r.doc_id == 5} == {(1, False), (2, False), (5, True)}
    assert {(r.first_doc_id, r.keep) for r in got if r.doc_id == 9} == {(1, False), (2, False), (5, False)}
    assert sum(r.n_bytes for r in got if r.doc_id in (5, 9)) == 2 * len(copy.encode())

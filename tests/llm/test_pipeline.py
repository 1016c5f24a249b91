import hashlib
import random

import corpus_pipeline as C
from lumitie.llm import pii
from lumitie.llm.queries import PII_KEY
from lumitie.llm.shingle import WORDS


def grams(text):
    w = text.lower().split()
    return {tuple(w[i:i + WORDS]) for i in range(len(w) - WORDS + 1)}


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    base = docs.collect()
    leak = items.first()["text"]
    words = base[5]["text"].split()
    extra = [(9001, None, "en", "s", 0), (9002, "123 456 -- 789", "en", "s", 14), (9003, base[7]["text"], "en", "s", 1),
             (9004, f"{base[9]['text']} {leak} {' '.join(rng.sample(words, 40))}", "en", "s", 1),
             (9005, " ".join(rng.sample(words, len(words))) + " mail a.b@c.example.org", "en", "s", 1)]
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    at = {}
    for name, step in C.STAGES:
        out = step(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, frame = frame, spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = frame.collect()
        assert name == "encoding" or frame.columns == columns
    first = {r.doc_id for r in at["language"]}
    assert first == {r.doc_id for r in [*base]} | {9003, 9004, 9005}
    texts = {r.doc_id: r.text for r in at["language"]}
    sets = {i: grams(t) for i, t in texts.items()}
    kept = sorted(r.doc_id for r in at["near_duplicates"])
    classes = {i: {i} for i in texts}
    for i in texts:
        for j in texts:
            if i < j and (texts[i].lower().split() == texts[j].lower().split() or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0):
                both = classes[i] | classes[j]
                for x in both:
                    classes[x] = both
    assert kept == sorted({min(c) for c in classes.values()})
    tests = [grams(r.text) for r in items.collect()]
    clean = sorted(i for i in kept if not any(len(t & sets[i]) >= 0.8 * len(t) for t in tests))
    assert sorted(r.doc_id for r in at["decontamination"]) == clean and 9004 not in clean and 9005 in clean
    keyed = pii.Surrogates(PII_KEY)
    hidden = {i: pii.replace(texts[i], keyed)[0] for i in clean}
    assert {r.doc_id: r.text for r in at["personal_data"]} == hidden and "a.b@c" not in hidden[9005]
    assert all(r.n_chars == len(r.text) for r in at["personal_data"])
    assert {r.doc_id: r.decoded_sha256 for r in at["encoding"]} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in hidden.items()}

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lumitie.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()
CODEC = bpe.Codec(DATA)
OTHER = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())})


def ids(text):
    out = CODEC.encode(text)
    return [int.from_bytes(out[k:k + 4], "little") for k in range(0, len(out), 4)]


TEXTS = ["", " ", "a", "Hello world", "it's we'll I'D  x\n\n y\t", "été naïf ½ ² 3", "日本語のテキスト １２３", "—“quoted”… 5€",
         "a" * 3000, "ab" * 4000, "Ᲊ\U00010d40 \U000323b0x", "tab line　wide", "\x1c\x1d x\x85y", "🙂🙂 é",
         "<|endoftext|>", "الخط 123 עברית", "\x00\x00 \x7f"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(text):
    assert ids(text) == OTHER.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_random_texts():
    rng = random.Random(5)
    pools = ["abc 'stred\n\t ", "aé½ —²　", "".join(chr(rng.randrange(32, 0x2ffff)) for _ in range(300))]
    for _ in range(300):
        pool = rng.choice(pools)
        text = "".join(c for c in (rng.choice(pool) for _ in range(rng.randrange(60))) if not 0xd800 <= ord(c) < 0xe000)
        assert ids(text) == OTHER.encode_ordinary(text)


def test_one_very_long_word():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    assert CODEC.decode(CODEC.encode(text)) == text.encode()
    assert ids(text[:3000]) == OTHER.encode_ordinary(text[:3000])


def test_rows(spark):
    rows = [(1, "Hello world", 7), (1, "Hello world", 7), (2, None, 8), (None, "x", 9), (3, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in bpe.digests(docs, bpe.share_ranks(spark, PATH)).collect()}
    want = set()
    for i, t, _ in rows:
        e = OTHER.encode_ordinary(t or "")
        want.add((i, len(e), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest(),
                  hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.digests(docs.limit(0), bpe.share_ranks(spark, PATH)).count() == 0

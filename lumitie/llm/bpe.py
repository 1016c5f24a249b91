"""Byte-level BPE encoding and decoding.

Each pre-token is merged over a segment tree whose leaves are its byte positions.  A leaf
holds the rank of the pair that starts there, an inner node the leftmost minimum below it,
so the next merge is read off the root and changes at most three leaves, each in
logarithmic time.  A pre-token of n bytes takes O(n log n), however long it is.

Rows stay where they are: encoding and decoding are narrow, without any shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitie.llm.batches import small_batches

#: Largest rank file that is sent to the executors.
MAX_RANK_BYTES = 64 << 20
#: Bytes of one of the two generations of pre-tokens that a worker remembers, about, and the longest that it remembers.
CACHE_BYTES, CACHE_CHARS = 40 << 20, 64
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Above every rank.
NO_RANK = 1 << 40

# Letters and numbers that Unicode 16 added to 15.1, as first-last in hexadecimal.
LETTERS_16 = ("1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 "
              "1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa "
              "16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0")
NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
# White space, as members of a character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters and numbers below U+0250; every other character that PLAIN admits is neither.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
PLAIN = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20c0]*")


def _splitter(letters: str, numbers: str) -> re.Pattern:
    """The split of the public tokenizer's pattern, with its classes spelt out."""
    return re.compile(f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+"
                      f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _category_class(first: str, more: str) -> str:
    """Members of a Unicode category as a character class."""
    points = {c for c in range(0x110000) if unicodedata.category(chr(c))[0] == first}
    for part in more.split():
        low, high = (int(x, 16) for x in part.split("-"))
        points.update(range(low, high + 1))
    spans: list[list[int]] = []
    for c in sorted(points):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


_LATIN = _splitter(LATIN_LETTERS, LATIN_NUMBERS)
_FULL: list[re.Pattern] = []


def split(text: str) -> list[str]:
    """Pre-tokens of a text.  Texts in Latin script take a pattern with small classes; both agree on them."""
    if PLAIN.fullmatch(text):
        return _LATIN.findall(text)
    if not _FULL:
        _FULL.append(_splitter(_category_class("L", LETTERS_16), _category_class("N", NUMBERS_16)))
    return _FULL[0].findall(text)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: base64 token and rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token, merging the leftmost pair of lowest rank until none is left.

    A leaf is the pair's rank times the number of leaves plus its position, so the smallest
    entry is the leftmost pair of lowest rank and names its place.
    """
    if piece in ranks:
        return [ranks[piece]]
    n, look = len(piece), ranks.get
    leaves = n - 1
    tree = [NO_RANK] * leaves
    tree += [NO_RANK if (rank := look(piece[i:i + 2])) is None else rank * leaves + i for i in range(leaves)]
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) != NO_RANK:
        at = best % leaves
        gone = after[at]
        end = after[gone]
        after[at] = end
        if end < n:
            before[end] = at
            rank = look(piece[at:after[end]])
            points = (at, NO_RANK if rank is None else rank * leaves + at), (gone, NO_RANK)
        else:
            points = ((at, NO_RANK),)
        left = before[at]
        if left >= 0:
            rank = look(piece[left:end])
            points += ((left, NO_RANK if rank is None else rank * leaves + left),)
        for k, low in points:
            k += leaves
            if tree[k] == low:
                continue
            tree[k] = low
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < low:
                    low = other
                if tree[k] == low:
                    break
                tree[k] = low
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:after[at]]])
        at = after[at]
    return ids


class Known(dict):
    """Ids of pre-tokens, as little-endian unsigned 32-bit integers, computed when first asked for.

    When the young generation is full it becomes the old one, and what is asked for again returns from there; so
    common pre-tokens stay and both together hold at most twice CACHE_BYTES.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.old, self.size = ranks, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            found = merge(word.encode("utf-8"), self.ranks)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= CACHE_CHARS:
            self.size += ENTRY_BYTES + len(word) + len(ids)
            if self.size > CACHE_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Ranks with the memory of one worker."""

    def __init__(self, data: bytes):
        ranks = parse_ranks(data)
        self.known = Known(ranks)
        sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.blob = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, split(text))) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        """Copy each token's bytes from the table of all tokens."""
        at = np.frombuffer(ids or b"", "<u4")
        sizes = self.sizes[at]
        if not (sizes > 0).all():
            raise ValueError("an id that stands for no token")
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[at] - ends + sizes, sizes)
        return self.blob[shift + np.arange(len(shift))].tobytes()


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker process and rank file."""
    key = hash(shared.value)
    if key not in _CODECS:
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def share_ranks(spark: SparkSession, path: str):
    """Send a rank file to the executors; its size is checked, as it must fit every worker."""
    with open(path, "rb") as source:
        data = source.read()
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes, more than {MAX_RANK_BYTES}")
    return spark.sparkContext.broadcast(data)


def _slices(column: pa.ChunkedArray | pa.Array, rows: int = 256) -> Iterator[list]:
    """Python values of a column, some rows at a time."""
    for k in range(0, len(column), rows):
        yield column.slice(k, rows).to_pylist()


def encode(docs: DataFrame, shared, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: the token ids of each whole text as little-endian uint32.

    A null or empty text has no ids.  Every row gives a row, repeated ones too; other columns
    are left out, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    part = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(batch.num_columns - 1)):
                ids = pa.array([codec.encode(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(at, len(texts)) for c in batch.columns[:-1]] + [ids],
                                                 [*keep, "ids"])
                at += len(texts)

    schema = part.drop("_text").schema.add("ids", "binary")
    return part.mapInArrow(run, schema)


def decode(encoded: DataFrame, shared, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for; null ids give no bytes, an unknown id raises."""

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            at, where = 0, batch.schema.get_field_index(ids)
            for rows in _slices(batch.column(where)):
                out = pa.array([codec.decode(x) for x in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(at, len(rows)) for c in batch.columns] + [out],
                                                 [*batch.schema.names, name])
                at += len(rows)

    from pyspark.sql.types import StructType

    return encoded.mapInArrow(run, StructType(list(encoded.schema.fields)).add(name, "binary"))


def digests(docs: DataFrame, shared, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, in one pass; ids and decoded bytes stay in the task."""
    small_batches(docs.sparkSession)
    part = docs.select("doc_id", F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            n, ids, decoded = [], [], []
            for texts in _slices(batch.column(1)):
                for one in map(codec.encode, texts):
                    n.append(len(one) // 4)
                    ids.append(hashlib.sha256(one).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(one)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = part.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return part.mapInArrow(run, schema)

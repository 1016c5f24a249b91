"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions alone.

The battery takes runs of 16 or more letters, digits and ``+/_-`` that hold a letter and a
digit, infers the smallest encoding that has all their symbols, and tests the symbols
against a uniform source: chi-squared for the shares of the alphabet, runs about the middle
of the alphabet, and correlation of neighbours.  Fisher's method joins the three.

How often plain text passes depends on the length, so it is measured over the whole corpus:
runs without any digit are the null population, counted by length class and score.  The chance that
plain text of some class of no greater length scores as well (the least such share: longer text passes
more rarely) is a candidate's p-value, and Benjamini-Hochberg over all candidates decides which are reported.  Only those counts,
at most 8 x 42 cells, reach the driver; the texts are read once for them and once for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run is taken whole, so a lower bound on its length drops the same matches as a later filter.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
# Alphabets from the smallest on.
LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {"hex": DIGITS + LOW[:6], "hex_upper": DIGITS + UP[:6], "base32": UP + "234567", "base32_lower": LOW + "234567",
             "base36": DIGITS + LOW, "base36_upper": DIGITS + UP, "base62": UP + LOW + DIGITS,
             "base64": UP + LOW + DIGITS + "+/", "base64_url": UP + LOW + DIGITS + "-_", "mixed": UP + LOW + DIGITS + "+/-_"}
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96)
TOP_SCORE = 41
BLOCK = 256


def running_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array, in blocks so that long arrays stay cheap."""

    def plain(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(values, start, lambda a, x: F.struct(
            (a["total"] + x).alias("total"), F.concat(a["sums"], F.array(a["total"])).alias("sums")), lambda a: a["sums"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def block(k: Column) -> Column:
        return F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    offsets = plain(F.transform(blocks, lambda k: total(block(k))))
    sums = F.zip_with(F.transform(blocks, lambda k: plain(block(k))), offsets,
                      lambda part, o: F.transform(part, lambda x: x + o))
    return F.when(F.size(lengths) < 1, F.array().cast("array<int>")).otherwise(F.flatten(sums))


def located(text: Column, pattern: str, hits: Column) -> Column:
    """Array of (start, end) in code points for the matches ``hits`` of a pattern in a text."""
    sizes = F.transform(hits, F.char_length)
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(hits))
    steps = F.zip_with(gaps, sizes, lambda g, s: g + s)
    starts = F.zip_with(running_sums(steps), gaps, lambda a, g: a + g)
    return F.zip_with(starts, sizes, lambda a, s: F.struct(a.alias("start"), (a + s).alias("end")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end); ``keep`` turns the matches into an array of booleans."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def found(both: Column) -> Column:
        all_ = F.zip_with(located(text, pattern, both["hits"]), both["keep"], lambda p, k: F.when(
            k, F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"))))
        return F.when(F.exists(both["keep"], lambda k: k), F.filter(all_, lambda x: x.isNotNull())).otherwise(none)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    keep = keep or (lambda h: F.transform(h, lambda x: F.lit(True)))
    return let(hits, lambda h: let(F.struct(h.alias("hits"), keep(h).alias("keep")), found))


def encoding(run: Column) -> Column:
    """The alphabet of the smallest encoding that has all symbols of a run without its padding."""
    out = F.lit(ALPHABETS["mixed"])
    for alphabet in reversed(list(ALPHABETS.values())[:-1]):
        out = F.when(F.translate(run, alphabet, "") == "", alphabet).otherwise(out)
    return out


def upper_tail(z: Column) -> Column:
    """P(normal > z) by the logistic approximation, within 2e-4; far tails by their bound."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(1.5976 * z + 0.07056 * z * z * z))


def score(run: Column) -> Column:
    """0 (as random as can be) to TOP_SCORE: -4 log10 of the joint p-value of the three tests."""
    s = F.rtrim(F.translate(run, "=", " "))
    with_alphabet = F.struct(s.alias("s"), encoding(s).alias("a"), F.length(s).cast("double").alias("n"))

    def values(t: Column) -> Column:
        k = F.length(t["a"])
        symbols = F.split(t["s"], "")
        squares = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda acc, c: acc + F.pow(
            t["n"] - F.length(F.replace(t["s"], c, F.lit(""))), F.lit(2.0)))
        return F.struct(k.cast("double").alias("k"), t["n"].alias("n"), squares.alias("squares"),
                        F.transform(symbols, lambda c: F.instr(t["a"], c) - 0.5 - k / 2).alias("v"))

    def counts(t: Column) -> Column:
        v = t["v"]
        signs = F.array_join(F.transform(v, lambda x: F.when(x < 0, "a").otherwise("b")), "")
        products = F.aggregate(F.zip_with(F.slice(v, F.lit(2), F.size(v)), v, lambda x, y: F.coalesce(x * y, F.lit(0.0))),
                               F.lit(0.0), lambda acc, x: acc + x)
        return let(signs, lambda w: F.struct(
            t["k"].alias("k"), t["n"].alias("n"), t["squares"].alias("squares"), products.alias("products"),
            F.length(F.replace(w, F.lit("b"), F.lit(""))).cast("double").alias("low"),
            F.size(F.regexp_extract_all(w, F.lit("a+|b+"), F.lit(0))).alias("runs")))

    def tests(t: Column) -> Column:
        k, n, low = t["k"], t["n"], t["low"]
        p_chi = upper_tail((k / n * t["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        mean = 2 * low * (n - low) / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = F.when((low == 0) | (low == n), F.pow(F.lit(2.0), 1 - n)).otherwise(
            2 * upper_tail(F.abs((t["runs"] - mean) / spread)))
        p_serial = 2 * upper_tail(F.abs(t["products"] / ((k * k - 1) / 12 * F.sqrt(n - 1))))
        return -F.ln(F.greatest(p_chi * p_runs * p_serial, F.lit(1e-30)))

    half = let(let(let(with_alphabet, values), counts), tests)
    joint = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
    return F.least(F.lit(TOP_SCORE), F.floor(-4 * F.log10(F.greatest(joint, F.lit(1e-30))))).cast("int")


def length_class(run: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTHS):
        out = F.when(F.length(run) >= low, i).otherwise(out)
    return out


def _has(run: Column, what: str) -> Column:
    return run.rlike(what)


def calibrate(docs: DataFrame, text: str = "text", rate: float = 0.05) -> dict[int, int]:
    """Worst score reported per length class, at a false discovery rate over the whole corpus.

    Without plain runs in the corpus there is no evidence about plain text, and nothing is reported.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run")).where("run rlike '[A-Za-z]'")
    cells = (runs.groupBy(_has(F.col("run"), "[0-9]").alias("candidate"), length_class(F.col("run")).alias("size"),
                          score(F.col("run")).alias("score")).agg(F.count(F.lit(1)).alias("n")).collect())
    plain = [[0] * (TOP_SCORE + 1) for _ in LENGTHS]
    for c in cells:
        if not c["candidate"]:
            plain[c["size"]][c["score"]] += c["n"]
    tested = []
    for c in cells:
        if c["candidate"]:
            p = min((1 + sum(counts[:c["score"] + 1])) / (1 + sum(counts)) for counts in plain[:c["size"] + 1])
            tested.append((p, c["size"], c["score"], c["n"]))
    tested.sort()
    total, upto, cut = sum(t[3] for t in tested), 0, -1.0
    for k, (p, _, _, n) in enumerate(tested):
        upto += n
        if (k + 1 == len(tested) or tested[k + 1][0] > p) and p * total <= rate * upto:
            cut = p
    out: dict[int, int] = {}
    for p, size, value, _ in tested:
        if p <= cut:
            out[size] = max(out.get(size, -1), value)
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: arrays of (start, kind, end), in code points, ends exclusive.

    ``_base`` holds the fixed patterns' spans, ``_added`` those of the battery that touch none of
    them.  A null text is taken as empty and has no spans.  Each row is scanned by itself.
    """
    limits = calibrate(docs, text, rate)
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(
        spans(body, ASSIGN, 0, lambda hits: F.transform(hits, lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 2)) >= 12)),
        spans(body, ACCESS, 1), spans(body, HEX, 2)))
    out = docs.withColumn("_base", base)
    if not limits:
        return out.withColumn("_added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    def reported(run: Column) -> Column:
        limit = F.lit(-1)
        for size, worst in limits.items():
            limit = F.when(length_class(run) == size, worst).otherwise(limit)
        return F.when(_has(run, "[0-9]") & _has(run, "[A-Za-z]"), score(run) <= limit).otherwise(F.lit(False))

    free = F.filter(spans(body, RUN, 3, lambda hits: F.transform(hits, reported)), lambda a: ~F.exists(
        F.col("_base"), lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"])))
    return out.withColumn("_added", free)


def joined(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = scan(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
                        joined(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
                        F.size("_added").cast("long").alias("n_random"))

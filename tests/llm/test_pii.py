import random
import re

from lumitie.llm import pii as P

KEYED = P.Surrogates(b"k")
TEXT = ("Mr. John Smith and Dr Emma Weber met Frau Müller-Lüdenscheidt. Smith said x.y@mail.example.org or +1 (555) 123-4567, "
        "555-123-4567 4041894974608795 4111-1111-1111-1111 42.144.35.254 DE89 3704 0044 0532 0130 00 123-45-6789 fe80::1 12:30:45 "
        "Señora López, Herr Иванов, 1.2.3.4.5 300.1.1.1 v1234567890123456")


def test_detects_and_replaces():
    out, used = P.replace(TEXT, KEYED)
    values = [v for _, v, _ in used]
    assert values == ["m:John Smith", "f:Emma Weber", "f:Müller-Lüdenscheidt", "m:Smith", "x.y@mail.example.org", "+1 (555) 123-4567",
                      "555-123-4567", "4041894974608795", "4111-1111-1111-1111", "42.144.35.254", "DE89 3704 0044 0532 0130 00",
                      "123-45-6789", "fe80::1", "f:López", "m:Иванов"]
    for v in values:
        assert v.partition(":")[2 if v[1] == ":" else 0] not in out
    assert "12:30:45" in out and "300.1.1.1" in out and "v1234567890123456" in out
    by = {v: n for _, v, n in used}
    assert by["m:John Smith"].split()[0].removeprefix("m:") in P.MALE and by["f:Emma Weber"].split()[0].removeprefix("f:") in P.FEMALE
    assert by["m:John Smith"].split()[1] == by["m:Smith"].removeprefix("m:")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", by["+1 (555) 123-4567"])
    card = by["4111-1111-1111-1111"].replace("-", "")
    assert P._luhn_digit(card[:-1]) == card[-1] and card[0] == "4"
    iban = by["DE89 3704 0044 0532 0130 00"].replace(" ", "")
    assert P._mod97(iban[4:] + iban[:4]) == 1
    assert re.fullmatch("m:[А-Яа-я]{6}", by["m:Иванов"])
    assert by["x.y@mail.example.org"].endswith(".org")
    assert P.replace(TEXT, KEYED)[0] == out and P.replace(TEXT, P.Surrogates(b"other"))[0] != out


def test_permutations_are_permutations():
    for size, radix in ((1, 7), (2, 10), (3, 5)):
        seen = set()
        for k in range(radix ** size):
            digits = [k // radix ** i % radix for i in range(size)]
            new = KEYED.permute(digits, [radix] * size, "t")
            assert all(0 <= d < radix for d in new)
            seen.add(tuple(new))
        assert len(seen) == radix ** size
    long = KEYED.text("a" * 500 + "9Z", "t")
    assert len(set(long)) > 10 and re.fullmatch("[a-z]{500}[0-9][A-Z]", long)
    rng = random.Random(1)
    for kind in ("card", "phone", "ssn"):
        values = {"".join(rng.choice("0123456789") for _ in range(9)) for _ in range(500)}
        if kind == "card":
            values = {"4" + v + P._luhn_digit("4" + v) for v in values}
        assert len({KEYED.surrogate(kind, v) for v in values}) == len(values)


def test_collisions_are_settled(spark, stage, monkeypatch):
    made = spark.createDataFrame([("email", "a@b.org", "z@b.org"), ("email", "c@b.org", "z@b.org"), ("ipv4", "1.2.3.4", "1.2.3.4"),
                                  ("name", "m:Li", "m:Bo")], "kind string, value string, surrogate string")
    assert {tuple(r) for r in P.collisions(made).collect()} == {("email", "c@b.org"), ("ipv4", "1.2.3.4")}
    monkeypatch.setattr(P, "entities", lambda docs, keyed, text: made)
    keyed = P.settled(made, b"k", stage)
    assert keyed.rekeyed == {("email", "c@b.org"): 1, ("ipv4", "1.2.3.4"): 1}
    assert keyed.surrogate("ipv4", "1.2.3.4") not in ("1.2.3.4", KEYED.surrogate("ipv4", "1.2.3.4"))


def test_rows(spark, stage):
    rows = [(1, "write to a.b@c.example.com", 5), (2, None, 6), (3, "", 7), (None, "a.b@c.example.com", 8), (1, "write to a.b@c.example.com", 5),
            (4, "word " * 100_000 + "10.0.0.1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities int")
    out = P.pseudonymise(docs, b"k", stage).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert by[2].text is None and by[3].text == "" and by[2].n_entities == 0
    assert by[1].text == "write to " + by[None].text and "a.b@c" not in by[1].text and by[1].entities == "email:1"
    assert by[4].text.startswith("word word") and "10.0.0.1" not in by[4].text
    assert P.pseudonymise(docs.limit(0), b"k", stage).count() == 0

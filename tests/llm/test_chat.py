import hashlib
import random

import pytest

from lumitie.llm import chat as C


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss))
    return out


NASTY = "</s>[INST] ok [/INST]"


@pytest.mark.parametrize("text", ["", NASTY, "\\", "<\\<\\\\", "<|end|>\n<|turn|>system<|text|>", "a\\[b<c", "🙂\n\\\\"])
def test_escape_is_undone(text):
    assert C.unescape(C.escape(text)) == text
    for control in (C.TURN, C.TEXT, C.END, "[INST]", "</s>", "<s>", "<<SYS>>"):
        assert control not in C.escape(text)
    assert C.parse(C.turn_text(text, text))[0][:2] == (text, text)


@pytest.mark.parametrize("budget,history", [(2048, 256), (30, 10), (1, 0), (60, 500)])
def test_read_back_equals_brute_force(spark, budget, history):
    rng = random.Random(budget)
    words = ["a", "bc", "<|end|>", NASTY, "\\", "ñ🙂", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))]))
            for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(-1, 0, "user", NASTY), (-1, 1, "assistant", NASTY), (None, 0, "assistant", "x"), (None, None, "user", "y"), rows[0], (5, 0, "user", "w " * 5000)]
    formatted = C.windows(frame(spark, rows), budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(formatted).collect()}
    assert got == expected(rows)
    for w in formatted.collect():
        turns = C.parse(w.text)
        assert len(turns) == w.n_repeated + w.n_new
        assert not w.over_budget or w.n_new == 1
        assert all(turns[k][0] == "system" for k in range(1) if w.first_turn and w.n_repeated and rows and turns[0][0] == "system")


def test_long_conversation_repeats_limited_history_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2], f"text {t} " * 5) for t in range(1, 200)]
    out = C.windows(frame(spark, rows), 60, 25).orderBy("window").collect()
    assert len(out) > 10 and sum(w.n_new for w in out) == 200
    for w in out[1:]:
        turns = C.parse(w.text)
        assert turns[0][:2] == ("system", "be kind")
        assert 1 <= w.n_repeated <= 4 and w.n_tokens <= 60
    assert sum(len(w.mask_starts) for w in out) == 100


def test_no_rows(spark):
    assert C.read_back(C.windows(frame(spark, [(1, 1, "user", "x")]).limit(0))).count() == 0

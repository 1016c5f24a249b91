"""Chat formatting: budgeted, turn-aligned windows with loss masks.

A conversation is cut into windows.  Each holds the system turn, a limited repeat of the turns
before it, and new turns for as long as the prefix sum of their tokens stays in the budget.
Only assistant texts among the new turns are under the loss mask, so each is trained on
once.  A turn is never cut: one that exceeds the budget by itself has a window of its own.

Turns are marked by control strings.  Texts and roles are escaped so that no control string can
appear inside them, and the escape is undone exactly on reading back.

Rows are dealt by conversation and sorted by turn inside Spark; a task then streams over them,
holding one window and the repeated history, so a conversation may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings.  Each starts with "<|", which escaped text never contains.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPED, ESCAPES = re.compile(r"[\\<\[]"), re.compile(r"([\\<\[])\\")
PIECES = re.compile(r"\w+|[^\w\s]")
WINDOW = ("conv_id long, window int, first_turn long, n_repeated int, n_new int, text string, "
          "mask_starts array<int>, mask_ends array<int>, n_tokens int, over_budget boolean")
COLUMNS = [c.split()[0] for c in WINDOW.split(", ")]
SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    """A backslash after every backslash, ``<`` and ``[``: no control string of any usual template survives."""
    return ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPES.sub(r"\1", text)


def count_tokens(text: str) -> int:
    """Words and punctuation marks."""
    return sum(1 for _ in PIECES.finditer(text))


def turn_text(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and start and end of the escaped text, of each turn in a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError("a turn does not begin with its mark")
        middle = formatted.index(TEXT, at)
        end = formatted.index(END, middle)
        start = middle + len(TEXT)
        out.append((unescape(formatted[at + len(TURN):middle]), unescape(formatted[start:end]), start, end))
        at = end + len(END) + 1
    return out


class _Conversation:
    """State of the conversation that is being read: system turn, history, and the open window."""

    def __init__(self, conv: int | None, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.past: deque = deque()
        self.past_tokens = self.number = self.position = 0
        self.new: list[tuple[str, str, int]] = []
        self.used = 0

    def head(self) -> int:
        """Tokens of the system turn and the repeated history of the open window."""
        return self.past_tokens + (self.system[2] if self.system and self.position > len(self.new) else 0)

    def add(self, role: str, text: str) -> dict | None:
        """Take a turn; the window that it closes, if any."""
        turn = (role, text, count_tokens(text) + 1)
        closed = None
        if self.new and self.head() + self.used + turn[2] > self.budget:
            closed = self.close()
        while not self.new and self.past and self.head() + turn[2] > self.budget:
            self.past_tokens -= self.past.popleft()[2]  # the history gives way to a long turn
        self.new.append(turn)
        self.used += turn[2]
        self.position += 1
        return closed

    def close(self) -> dict:
        first = self.position - len(self.new)
        repeated = list(self.past)
        if self.system and first > 0:
            repeated.insert(0, self.system)
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate([*repeated, *self.new]):
            part = turn_text(role, text)
            if k >= len(repeated) and role == "assistant":
                starts.append(at + len(TURN) + len(escape(role)) + len(TEXT))
                ends.append(at + len(part) - len(END) - 1)
            parts.append(part)
            at += len(part)
        tokens = sum(t[2] for t in [*repeated, *self.new])
        row = dict(zip(COLUMNS, (self.conv, self.number, first, len(repeated), len(self.new), "".join(parts),
                                 starts, ends, tokens, tokens > self.budget)))
        if first == 0 and self.new[0][0] == "system":
            self.system = self.new[0]
        self.past.extend(t for k, t in enumerate(self.new) if not (first == 0 and k == 0 and self.system))
        self.past_tokens += sum(t[2] for t in self.past) - self.past_tokens
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[2]
        self.new, self.used, self.number = [], 0, self.number + 1
        return row


def windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """Formatted windows of all conversations, in order within each partition.

    Turns are ordered by turn, then role, then text; a null text or role is empty, null ``turn``
    comes first, and rows with a null conv_id form one conversation.  Repeated rows are turns of
    their own.  Other columns are left out.
    """
    rows = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: _Conversation | None = None
        for frame in frames:
            out = []
            for conv, role, text in frame.itertuples(index=False):
                conv = None if conv is None else int(conv)
                if open_ is None or conv != open_.conv:
                    if open_ is not None:
                        out.append(open_.close())
                    open_ = _Conversation(conv, budget, history)
                if (row := open_.add(role, text)) is not None:
                    out.append(row)
            if out:
                yield _frame(out)
        if open_ is not None:
            yield _frame([open_.close()])

    return rows.mapInPandas(run, WINDOW)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from windows that follow each other within their partition.

    Hashes run over the unescaped turns without repeats, and over the text under the masks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None

        def row(s: dict) -> dict:
            return {"conv_id": s["conv"], "n_turns": s["turns"], "turns_sha256": s["all"].hexdigest(), "loss_chars": s["chars"],
                    "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["formatted"], "n_windows": s["windows"]}

        for frame in frames:
            out = []
            for w in frame.to_dict("records"):
                conv = None if pd.isna(w["conv_id"]) else int(w["conv_id"])
                if state is None or w["window"] == 0:
                    if state is not None:
                        out.append(row(state))
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0,
                             "formatted": 0, "windows": 0}
                state["formatted"] += len(w["text"])
                state["windows"] += 1
                for role, text, _, _ in parse(w["text"])[int(w["n_repeated"]):]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for start, end in zip(w["mask_starts"], w["mask_ends"]):
                    text = unescape(w["text"][start:end])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
            if out:
                yield summary(out)
        if state is not None:
            yield summary([row(state)])

    def summary(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])
        out["conv_id"] = out["conv_id"].astype("Int64")
        return out

    return formatted.mapInPandas(run, SUMMARY)

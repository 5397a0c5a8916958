"""Chat formatting in budgeted windows with a loss mask, and reading it back.

Turns are read in order and cut into windows of at most `budget` tokens, counted on the turns as they are
formatted. The system turns that open the conversation are retained: every window repeats those of them, from
the first on, that fit into the budget together (what doesn't fit stands once, as other turns do). A window
also repeats as many of the turns just before it as `history` tokens hold (prefix sums of the turns' tokens
say which), then has its own turns. A turn for which the budget has no room beside the retained turns gets a
window of its own, whole; only such a window is longer than the budget. The loss mask covers the texts of the
window's own assistant turns; repeated turns are masked out, so each assistant text is a target once.

A turn is OPEN role newline text CLOSE. Roles are percent-encoded; inside texts every backslash is
doubled and every control string gets a backslash after its first character, which is undone on reading.

Null texts and roles count as empty. Turns of equal number are ordered by role and text; a null number
comes first; rows with a null conv_id form one conversation; empty tables give no windows. A conversation's
rows pass through one task as a stream that holds one window at a time.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, short_batches
from .token_store import word_encoder

OPEN, CLOSE = "<s>", "</s>"
CONTROLS = ("<<SYS>>", "<</SYS>>", "[/INST]", "[INST]", CLOSE, OPEN)
BUDGET, HISTORY = 1024, 256
_ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_UNESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    return f"{OPEN}{quote(role, safe='')}\n", escaped(text), CLOSE


def formatted(turns: list[tuple[str, str]], own: int) -> tuple[str, list[dict[str, int]]]:
    """The window's text and the places (code points) of the targets; the last `own` turns are its own."""
    out, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body, close = turn_parts(role, text)
        if k >= len(turns) - own and role == "assistant":
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        out += [head, body, close]
        at += len(head) + len(body) + len(close)
    return "".join(out), spans


def windows_of(turns, budget: int = BUDGET, history: int = HISTORY):
    """(turns, number of own turns) of each window; turns: (role, text, tokens), read once."""
    system: list[tuple[str, str, int]] = []  # the retained turns
    fixed, opening = 0, True
    before: list[tuple[str, str, int]] = []
    own: list[tuple[str, str, int]] = []
    retained_here = 0  # how many of the window's own turns are the retained ones themselves
    used = 0

    def window():
        return [(r, t) for r, t, _ in (*([] if retained_here else system), *before, *own)], len(own)

    for turn in turns:
        opening = opening and turn[0] == "system" and fixed + turn[2] <= budget
        if own and used + turn[2] > budget:
            yield window()
            candidates = own[retained_here:]
            sums = list(itertools.accumulate((t[2] for t in reversed(candidates)), initial=0))
            fits = bisect.bisect_right(sums, min(history, max(0, budget - fixed - turn[2]))) - 1
            before, own, retained_here = candidates[len(candidates) - fits :] if fits else [], [], 0
            used = fixed + sum(t[2] for t in before)
        if opening:
            system.append(turn)
            fixed += turn[2]
            retained_here += 1
        own.append(turn)
        used += turn[2]
    if own:
        yield window()


def _by_conversation(batches):
    """(conv_id, iterator of rows) for rows that come sorted by conversation."""
    return _grouped(row for batch in batches for row in batch.to_pylist())


def _grouped(rows):
    return itertools.groupby(rows, key=lambda r: r["conv_id"])


def _sized(batches, words):
    """(conv_id, role, text, tokens) of each turn as formatted; the turns of a batch are encoded together."""
    for batch in batches:
        rows = [{"conv_id": r["conv_id"], "role": r["role"] or "", "text": r["text"] or ""} for r in batch.to_pylist()]
        shown = pa.array(["".join(turn_parts(r["role"], r["text"])).encode("utf-8", "surrogatepass") for r in rows], pa.binary()).view(pa.string())
        for row, ids in zip(rows, words.batch_ids(shown), strict=True):
            yield row | {"tokens": len(ids) // 4}


_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("own", pa.int64()), ("targets", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _formatter(tokenizer_path: str, budget: int, history: int):
    def rows(batches):
        words = word_encoder(tokenizer_path)
        held: list[dict] = []
        for conv_id, turns in _grouped(_sized(batches, words)):
            sized = ((r["role"], r["text"], r["tokens"]) for r in turns)
            for k, (window, own) in enumerate(windows_of(sized, budget, history)):
                text, spans = formatted(window, own)
                held.append({"conv_id": conv_id, "window": k, "text": text, "own": own, "targets": spans})
                if len(held) >= 256:
                    yield pa.RecordBatch.from_pylist(held, schema=_WINDOWS)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema=_WINDOWS)

    return rows


def windows(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, window, text, own, targets): the formatted windows with the places of their targets."""
    short_batches(conversations.sparkSession)
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatter(tokenizer_path, budget, history), "conv_id long, window long, text string, own long, targets array<struct<start: long, stop: long>>")


def read_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unquote(role), unescaped(body)) for role, body in _TURN.findall(text)]


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def _read(batches):
    held = []
    for conv_id, rows in _by_conversation(batches):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        out = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_windows": 0}
        for row in rows:
            found = read_window(row["text"])
            for role, text in found[len(found) - row["own"] :]:
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in row["targets"]:
                target = unescaped(row["text"][span["start"] : span["stop"]])
                loss.update(target.encode("utf-8", "surrogatepass"))
                out["loss_chars"] += len(target)
            out["n_turns"] += row["own"]
            out["formatted_chars"] += len(row["text"])
            out["n_windows"] += 1
        held.append(out | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})
        if len(held) >= 256:
            yield pa.RecordBatch.from_pylist(held, schema=_READ)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=_READ)


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) of windows' rows."""
    short_batches(formatted_windows.sparkSession)
    dealt = formatted_windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def round_trip(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    return read_back(saved(windows(conversations, tokenizer_path, budget, history), "chat-windows"))

"""Chat formatting in budgeted windows.

A conversation's turns, in order, are written with a template that marks each turn; control strings inside texts
and roles are escaped reversibly. Prefix sums of the turns' tokens, counted with a public vocabulary, choose windows of whole turns: a window keeps
the system turn, repeats as much of the turns before it as `history` tokens hold, and takes new turns while the
budget lasts (one new turn at least, so no text is cut: a turn beyond the budget has a window of its own, without history). Targets are the assistant turns that are new in a window: each once;
repeated ones are masked.

Defined cases: null texts and roles are empty; turns with one number come by role, then text; a null turn number
comes first; repeated rows are turns of their own; a conversation of one turn has one window; an empty table gives
no row; null conv_ids form one conversation; other columns are not read. A conversation is one row of the result, so it
has to fit in a row's memory.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.token_counts import VOCABULARY, encoder, read_vocabulary

BUDGET = 512
HISTORY = 128

#: The template's marks, and control strings of other templates that no text may smuggle in.
WINDOW, NEW, AGAIN, TEXT, END = "<|window|>", "<|turn|>", "<|again|>", "<|text|>", "<|end|>"
CONTROL = (WINDOW, NEW, AGAIN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")

_control = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_escaped = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""Doubles every backslash and puts one after the first character of every control string."""
    return _control.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def turn_tokens(encode, role: str, text: str) -> int:
    """Tokens of the role and the text as they are written, escaped, and one for each of the turn's three marks."""
    return len(encode(escape(text))) + len(encode(escape(role))) + 3


def windows(tokens: list[int], system: bool, budget: int = BUDGET, history: int = HISTORY) -> list[tuple[bool, int, int, int]]:
    """(system kept, first repeated turn, first new turn, end) of each window, from prefix sums of the turns' tokens; system: the first turn is the system's."""
    n = len(tokens)
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    own = int(sums[1]) if system else 0
    out, at = [], 0
    while at < n:
        again = at
        if at:
            again = max(int(np.searchsorted(sums, sums[at] - history)), int(system))
            again = min(again, at)
        keeps = system and again > 0 and at > 0
        used = (own if keeps else 0) + int(sums[at] - sums[again])
        end = int(np.searchsorted(sums, sums[at] + max(0, budget - used), side="right")) - 1
        if end <= at and again < at:  # no room for a new turn beside the history
            again = at
            used = own if keeps else 0
            end = int(np.searchsorted(sums, sums[at] + max(0, budget - used), side="right")) - 1
        end = max(at + 1, end)
        out.append((keeps, again, at, end))
        at = end
    return out


def format_window(turns: list[tuple[str, str]], window: tuple[bool, int, int, int]) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and the spans under the loss mask: the escaped texts of its new assistant turns."""
    keeps, again, new, end = window
    out, spans, size = [WINDOW], [], len(WINDOW)
    for i in ([0] if keeps else []) + list(range(again, end)):
        role, text = escape(turns[i][0]), escape(turns[i][1])
        fresh = i >= new
        head = f"{NEW if fresh else AGAIN}{role}{TEXT}"
        if fresh and turns[i][0] == "assistant":
            spans.append((size + len(head), size + len(head) + len(text)))
        out += [head, text, END]
        size += len(head) + len(text) + len(END)
    return "".join(out), spans


_turn = re.compile(f"({re.escape(NEW)}|{re.escape(AGAIN)})(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def read_window(text: str) -> list[tuple[bool, str, str]]:
    """(new, role, text) of each turn of a formatted window; escapes keep the marks unambiguous."""
    return [(m[1] == NEW, unescape(m[2]), unescape(m[3])) for m in _turn.finditer(text)]


def _convert(budget: int, history: int, vocabulary):
    def convert(batches):
        encode = encoder(vocabulary.value).encode_ordinary
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                pairs = [(t["role"], t["text"]) for t in turns]
                tokens = [turn_tokens(encode, *t) for t in pairs]
                formatted = [format_window(pairs, w) for w in windows(tokens, bool(pairs) and pairs[0][0] == "system", budget, history)]
                rows.append({"conv_id": conv, "windows": [{"text": t, "targets": [{"start": a, "end": b} for a, b in spans]} for t, spans in formatted]})
            yield pa.RecordBatch.from_pylist(rows, schema=_WINDOWS)

    return convert


_WINDOWS = pa.schema([("conv_id", pa.int64()), ("windows", pa.list_(pa.struct([("text", pa.string()), ("targets", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])))])


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """conv_id, windows: array of (text, targets), targets being spans (code points) of the text under the loss mask."""
    vocabulary = conversations.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.mapInArrow(_convert(budget, history, vocabulary), "conv_id long, windows array<struct<text:string,targets:array<struct<start:long,end:long>>>>")


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, from formatted() output alone."""

    def read(batches):
        for batch in batches:
            rows = []
            for conv, found in zip(batch.column("conv_id").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                turns = [t for w in found for t in read_window(w["text"]) if t[0]]
                loss = "".join(unescape(w["text"][t["start"] : t["end"]]) for w in found for t in w["targets"])
                digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": digest, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), "formatted_chars": sum(len(w["text"]) for w in found), "n_windows": len(found)})
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)

    return output.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

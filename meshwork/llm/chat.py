"""Chat formatting with an offset-aligned loss mask.

A conversation is rendered whole, encoded once with offsets, and its assistant texts' spans are intersected with the
token spans by binary search. Turns are marked by strings that the tokenizer treats as single tokens, so no token
crosses from a mark into a text. Such strings inside texts are escaped, reversibly, by backslashes after their first
character.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import lean

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates use as controls. None may stand unescaped in a text.
CONTROLS = [START, MIDDLE, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_BARE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_MARKED = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.S)
#: Characters of rendered text that are encoded together.
CHUNK = 1 << 20
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
FORMAT_TYPES = "conv_id long, formatted string, ids array<int>, mask array<boolean>, starts array<int>, ends array<int>"


def escape(text: str) -> str:
    """The text with one backslash more after the first character of every control string, and of every escaped one."""
    return _BARE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def loss_mask(starts: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token, of sorted starts, begins in one of the sorted disjoint spans."""
    if not spans or not len(starts):
        return np.zeros(len(starts), bool)
    opens, closes = np.array(spans).T
    at = np.searchsorted(opens, starts, side="right") - 1
    return (at >= 0) & (starts < closes[np.maximum(at, 0)])


def load(path: str):
    """The tokenizer of a file, with the marks as single tokens and offsets that keep white space.

    The file has to stand at path on every executor, or to be shipped by SparkContext.addFile.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (START, MIDDLE, END)])
    return tokenizer


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)

        def flush(held: list[tuple[int | None, str, list[tuple[int, int]]]]) -> pa.RecordBatch:
            encoded = tokenizer.encode_batch([f for _, f, _ in held], add_special_tokens=False)
            masks, starts, ends = [], [], []
            for e, (_, _, spans) in zip(encoded, held, strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                masks.append(loss_mask(offsets[:, 0], spans))
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _, _ in held], pa.int64()), pa.array([f for _, f, _ in held]), pa.array([e.ids for e in encoded], ints), pa.array(masks, pa.list_(pa.bool_())), pa.array(starts, ints), pa.array(ends, ints)],
                names=["conv_id", "formatted", "ids", "mask", "starts", "ends"],
            )

        held, size = [], 0
        for conv, turns in _conversations(batches):
            formatted, spans = render(turns)
            held.append((conv, formatted, spans))
            size += len(formatted)
            if size >= CHUNK:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Runs of equal conv_id, whose rows follow each other."""
    conv, turns = None, []
    for data in batches:
        for c, role, text in zip(*(x.to_pylist() for x in data.columns), strict=True):
            if turns and c != conv:
                yield conv, turns
                turns = []
            conv = c
            turns.append((role or "", text or ""))
    if turns:
        yield conv, turns


def format_chats(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, formatted, ids, mask, starts, ends) of every conversation in rows (conv_id, turn, role, text).

    Turns stand by turn (null first), ties by role and text; repeated rows are turns of their own. A null role or
    text counts as empty; rows without conv_id are one conversation. mask marks the tokens of assistant texts.
    Rows are sorted by conversation and streamed, so a task holds one conversation at a time and about a million
    characters to encode: a conversation, being one training example that is encoded once, has to fit into a task.
    An empty table gives an empty result; further columns are not read.
    """
    lean(rows.sparkSession)
    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select(F.col("conv_id").cast("long"), "role", "text").mapInArrow(_format(tokenizer), FORMAT_TYPES)


DIGEST_TYPES = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def masked_text(formatted: str, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The unescaped text of each run of masked tokens, by the tokens' offsets."""
    on = np.flatnonzero(np.diff(np.concatenate([[False], np.asarray(mask, bool), [False]]).astype(np.int8)))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(on[::2], on[1::2], strict=True)]


def _slices(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's list as an array, without a Python object for an entry."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data in batches:
        out: list[list] = [[] for _ in range(8)]
        for conv, formatted, mask, starts, ends in zip(data.column(0).to_pylist(), data.column(1).to_pylist(), *(_slices(data.column(i)) for i in (2, 3, 4)), strict=True):
            turns = parse(formatted)
            loss = "".join(masked_text(formatted, mask, starts, ends))
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            row = conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), len(mask), int(mask.sum())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats: turns, and the text under the mask, as lengths and SHA-256."""
    return formatted.select("conv_id", "formatted", "mask", "starts", "ends").mapInArrow(_digest, DIGEST_TYPES)

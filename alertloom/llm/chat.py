"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with character offsets, and a token is under the
loss mask if binary search finds its start inside a span of assistant text. Layout of one turn:

    [INST]role[/INST]text</s>        with <s> before the first turn

The four control strings are special tokens, so no token crosses the edge of a turn. Inside roles
and texts a backslash after the first character breaks every control string, and backslashes are
doubled; ``unescape`` takes this back exactly.

Rows are sorted by conversation and turn and streamed: a worker holds one segment, never a whole
conversation. Conversations above ``SEGMENT_CHARS`` come as several rows, cut between turns, where
encoding in parts and as a whole agree.

Defined results: null texts and roles are empty; turns that share a number (or have none: first) are
ordered by role, then text; repeated rows are turns of their own; rows without a conversation id form
one conversation; an empty table gives an empty result; further columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
SEGMENT_CHARS = 1_000_000
BUFFER_CHARS = 2_000_000  # rendered text that a worker encodes and sends on at a time
FORMATTED = ("conv_id long, segment int, n_turns int, formatted string, token_ids array<int>, "
             "token_starts array<int>, token_ends array<int>, loss_mask array<boolean>")
_BREAK = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _BREAK.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def load_tokenizer(path: str):
    """The vocabulary at ``path`` with the control strings as special tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors
    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
    return tokenizer


def render(turns: list[tuple[str, str]], first: bool) -> tuple[str, list[int], list[int]]:
    """Text of a segment and the sorted spans of its assistant texts."""
    parts, at, starts, ends = (["<s>"], 3, [], []) if first else ([], 0, [], [])
    for role, text in turns:
        head, body = f"[INST]{escape(role)}[/INST]", escape(text)
        at += len(head)
        if role == "assistant":
            starts.append(at)
            ends.append(at + len(body))
        at += len(body) + len("</s>")
        parts += [head, body, "</s>"]
    return "".join(parts), starts, ends


def loss_mask(token_starts: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """Whether each token starts inside one of the sorted spans."""
    if not starts:
        return np.zeros(len(token_starts), dtype=bool)
    at = np.searchsorted(starts, token_starts, side="right") - 1
    return (at >= 0) & (token_starts < np.asarray(ends)[at])


def segments(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, segment, turns) of rows (conv_id, role, text) that come in order."""
    for conv, own in groupby(rows, key=lambda row: row[0]):
        turns, chars, segment = [], 0, 0
        for _, role, text in own:
            if turns and chars + len(text or "") > SEGMENT_CHARS:
                yield conv, segment, turns
                turns, chars, segment = [], 0, segment + 1
            turns.append((role or "", text or ""))
            chars += len(text or "")
        yield conv, segment, turns


def _formatter(path: str):
    def run(batches):
        tokenizer = load_tokenizer(path)
        held, chars = [], 0
        for conv, segment, turns in segments(_rows(batches, "conv_id", "role", "text")):
            text, starts, ends = render(turns, segment == 0)
            held.append((conv, segment, len(turns), text, starts, ends))
            chars += len(text)
            if chars > BUFFER_CHARS:
                yield _encoded(tokenizer, held)
                held, chars = [], 0
        if held:
            yield _encoded(tokenizer, held)
    return run


def _rows(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _encoded(tokenizer, held: list[tuple]) -> pa.RecordBatch:
    out = []
    for row, code in zip(held, tokenizer.encode_batch([h[3] for h in held],
                                                      add_special_tokens=False)):
        offsets = np.array(code.offsets, dtype=np.int32).reshape(-1, 2)
        out.append((*row[:4], np.array(code.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1],
                    loss_mask(offsets[:, 0], row[4], row[5])))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3,
             pa.list_(pa.bool_())]
    names = [field.split()[0] for field in FORMATTED.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows of FORMATTED; the segments of a conversation stand together, in order, in one partition."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatter(tokenizer), FORMATTED)


def loss_text(text: str, starts, ends, mask) -> Iterator[str]:
    """The unescaped runs of text under the mask; tokens that share a character count it once."""
    mask = np.asarray(mask, dtype=bool)
    starts, ends = np.asarray(starts)[mask], np.asarray(ends)[mask]
    if not len(starts):
        return
    breaks = np.flatnonzero(starts[1:] > np.maximum.accumulate(ends)[:-1]) + 1
    for run in np.split(np.arange(len(starts)), breaks):
        yield unescape(text[starts[run[0]]:ends[run].max()])


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def read_back(batches):
    """Digests of every conversation, from nothing but the formatted rows."""
    rows = _rows(batches, "conv_id", "formatted", "token_starts", "token_ends", "loss_mask")
    out = []
    for conv, own in groupby(rows, key=lambda row: row[0]):
        turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, text, starts, ends, mask in own:
            size += len(text)
            for role, body in _TURN.findall(text):
                turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                n += 1
            for run in loss_text(text, starts, ends, mask):
                loss.update(run.encode())
                chars += len(run)
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        if len(out) == 1000:
            yield _digest_batch(out)
            out = []
    if out:
        yield _digest_batch(out)


def _digest_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

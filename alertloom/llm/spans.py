"""What the two span finders share: sampling, training and applying a field, digests of spans."""

import copy
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.crf import Field

Span = tuple[str, int, int]
# Bounds of what teaches a field: tokens of a sequence, sequences of the sample.
PIECE, SAMPLE_PIECES = 32, 6000
TEXTS = 20  # texts whose sequences leave a task together; they are many times as large as their text


def inline(sentence: str) -> tuple[str, list[Span]]:
    """Text and spans of a sentence that marks them as [[kind|text]]."""
    text, spans = "", []
    for k, part in enumerate(sentence.split("[[")):
        if k:
            tagged, part = part.split("]]", 1)
            kind, body = tagged.split("|", 1)
            spans.append((kind, len(text), len(text) + len(body)))
            text += body
        text += part
    return text, spans


def pieces(field: Field, text: str, spans: list[Span]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of a text's sequences, long ones in parts of at most ``PIECE`` tokens."""
    for tokens, feats in field.sequences(text):
        labels = field.label(tokens, spans)
        for at in range(0, len(tokens), PIECE):
            yield feats[at:at + PIECE], labels[at:at + PIECE]


def _piece_rows(docs: DataFrame, id_col: str, text_col: str, field: Broadcast,
                rules: Callable[[str], list[Span]], rows: int) -> DataFrame:
    """Features, rule labels and number of tokens of at most ``SAMPLE_PIECES`` sequences of ``rows`` documents,
    the same in each run: those of least hashed id and text, then those that hold a span and those of least hash."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
            out = [(x.astype(np.int32).tobytes(), y.astype(np.int32).tobytes(), len(y), bool(y.any()))
                   for text in some.column(0).to_pylist() for x, y in pieces(field.value, text, rules(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.bool_()))],
                names=["x", "y", "n", "marked"])

    h = F.xxhash64(F.col(id_col), F.col(text_col))
    chosen = (docs.where(F.length(text_col) > 0).select(h.alias("h"), F.col(text_col).alias("text"))
              .orderBy("h", "text").limit(rows).select("text"))
    found = chosen.mapInArrow(learn, "x binary, y binary, n int, marked boolean")
    return (found.orderBy(F.desc("marked"), F.xxhash64("x", "y"), "x", "y").limit(SAMPLE_PIECES)
            .select("x", "y", "n"))


def _piece(x: bytes, y: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x, np.int32).reshape(n, -1), np.frombuffer(y, np.int32)


def sampled_pieces(docs: DataFrame, id_col: str, text_col: str, field: Field,
                   rules: Callable[[str], list[Span]], rows: int) -> list:
    """The sampled sequences as (features, labels)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return [_piece(*r) for r in _piece_rows(docs, id_col, text_col, shared, rules, rows).collect()]


def trained(docs: DataFrame, id_col: str, text_col: str, field: Field, table: tuple[str, ...],
            rules: Callable[[str], list[Span]], rows: int) -> Field:
    """The field fitted on the labelled sentences and on rule spans of a bounded sample.

    Neither texts nor sequences come to the driver: one task fits the field, the driver gets its weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def fitted(sampled: Iterable[tuple[np.ndarray, np.ndarray]]) -> Field:
        learned = [p for sentence in table for p in pieces(shared.value, *inline(sentence))] + list(sampled)
        return copy.deepcopy(shared.value).fit([x for x, _ in learned], [y for _, y in learned])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fitted(_piece(*r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.emit.tobytes()], pa.binary()), pa.array([own.move.tobytes()], pa.binary())], names=["emit", "move"])

    found = (_piece_rows(docs, id_col, text_col, shared, rules, rows).coalesce(1)
             .mapInArrow(fit, "emit binary, move binary").collect())
    if not found:  # no partition, no task
        return fitted([])
    (weights,) = found
    field.emit[:], field.move[:] = (np.frombuffer(weights[k], np.float32).reshape(getattr(field, k).shape)
                                    for k in ("emit", "move"))
    return field


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sorted_spans(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def added(tagged: list[Span], base: list[Span]) -> list[Span]:
    """Tagged spans that overlap no base span, as kind ``likely_...``."""
    ordered = sorted(base, key=lambda s: s[1])
    starts = np.array([start for _, start, _ in ordered])
    ends = np.maximum.accumulate([end for _, _, end in ordered] or [0])
    out = []
    for kind, start, end in tagged:
        at = np.searchsorted(starts, end, side="left") - 1
        if at < 0 or ends[at] <= start:
            out.append((f"likely_{kind}", start, end))
    return out


def _found(field: Field, rules: Callable[[str], list[Span]], kinds: tuple[str, ...],
           texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    for text, tagged in zip(texts, field.tag(texts)):
        base = sorted_spans(rules(text), kinds)
        yield base, sorted_spans(base + added(tagged, base), kinds)


def finder(docs: DataFrame, field: Field, rules: Callable[[str], list[Span]],
           base_kinds: tuple[str, ...], text: Column) -> Column:
    """Struct of counts, base digest and all spans for each whole text; null counts as empty.

    The field travels to the workers once, as a broadcast of a few hundred kilobytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kinds = base_kinds + tuple(f"likely_{k}" for k in field.kinds)
    names = [f"n_{k}" for k in base_kinds]
    schema = ", ".join([f"{n} long" for n in names] + ["base_sha256 string", "spans string",
                       "starts array<int>", "ends array<int>"])

    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for base, every in _found(shared.value, rules, kinds, [t or "" for t in texts]):
            rows.append((*[sum(s[0] == k for s in base) for k in base_kinds],
                         hashlib.sha256(joined(base).encode()).hexdigest(), joined(every),
                         [s[1] for s in every], [s[2] for s in every]))
        return pd.DataFrame(rows, columns=names + ["base_sha256", "spans", "starts", "ends"])

    find.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(find, schema).asNondeterministic()(text)


def redacted(docs: DataFrame, field: Field, rules: Callable[[str], list[Span]],
             base_kinds: tuple[str, ...], text: Column, mark: str) -> Column:
    """The text with every span that ``finder`` finds replaced; overlapping spans are replaced together.

    Spans are found and cut out by one function, so that a task needs one Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kinds = base_kinds + tuple(f"likely_{k}" for k in field.kinds)

    def cut(texts: pd.Series) -> pd.Series:
        found = _found(shared.value, rules, kinds, [t or "" for t in texts])
        return pd.Series([t and without(t, every, mark) for t, (_, every) in zip(texts, found)], dtype=object)

    cut.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, "string").asNondeterministic()(text)


def without(text: str, spans: list[Span], mark: str) -> str:
    """The text with a mark in place of its spans, which are sorted by their start."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        elif end <= at:
            continue
        at = max(at, end)
    return "".join(parts) + text[at:]

"""Quality rules: zstandard compression bands over whole texts and fixed chunks.

Text that compresses far better than prose of its length repeats itself; text that hardly compresses
is noise. Both limits depend on the length, as short texts compress worse.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged
each by itself; an empty table gives an empty result; further columns pass through untouched.
Texts of any length are judged whole.
"""

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import free_name

LEVEL = 3
CHUNK_BYTES = 4096
# (below this many bytes, least ratio, greatest ratio) of whole texts.
BANDS = (
    (100, 0.20, 9.0),
    (400, 0.40, 1.30),
    (1600, 0.35, 0.85),
    (6400, 0.30, 0.80),
    (float("inf"), 0.22, 0.78),
)
# The same for chunks; at most this share of a text's chunks may lie outside.
CHUNK_BAND = (0.25, 0.85)
CHUNK_SHARE = 1 / 3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, odd_chunks long, n_chunks long, kept boolean")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice; exact, by ranking doubled windows."""
    if len(words) <= WINDOW:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    width = 1
    while width < WINDOW:
        ids = pd.factorize(ids[:-width] * len(words) + ids[width:])[0].astype(np.int64)
        width *= 2
        if ids.max() + 1 == len(ids):
            return 0
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:-WINDOW][again] += 1
    edges[WINDOW:][again] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def in_bands(text: bytes, packer) -> tuple[bool, float, int, int]:
    """Verdict, whole ratio, chunks outside their band, chunks."""
    ratio = len(packer.compress(text)) / len(text)
    low, high = next((low, high) for below, low, high in BANDS if len(text) < below)
    chunks = odd = 0
    for start in range(0, len(text), CHUNK_BYTES):
        chunk = text[start:start + CHUNK_BYTES]
        if 2 * len(chunk) < CHUNK_BYTES:  # a short rest compresses by other rules
            break
        chunks += 1
        packed = len(packer.compress(chunk)) / len(chunk)
        odd += not CHUNK_BAND[0] <= packed <= CHUNK_BAND[1]
    return low <= ratio <= high and odd <= CHUNK_SHARE * chunks, ratio, odd, chunks


def judge(text: bytes | None, packer) -> tuple:
    """One row of SCHEMA."""
    text = text or b""
    words = text.split()  # bytes.split knows exactly the white space of the word definition
    n = len(words)
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text) - len(text.decode("utf-8", "replace"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    symbols = sum(text.count(s.encode()) for s in SYMBOLS)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    good, ratio, odd, chunks = in_bands(text, packer) if text else (False, None, 0, 0)
    return (n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, ratio, odd, chunks,
            not failed and good)


def _rules(texts: pd.Series) -> pd.DataFrame:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pd.DataFrame([judge(t, packer) for t in texts], columns=names)


def rules(text: Column) -> Column:
    """Struct of counts, ratios and the verdict ``kept`` for each whole text."""
    return F.pandas_udf(_rules, SCHEMA).asNondeterministic()(text.cast("binary"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes; columns as they came."""
    name = free_name(docs, "rules")
    judged = docs.withColumn(name, rules(F.col(text_col)))
    return judged.where(F.col(f"{name}.kept")).drop(name)

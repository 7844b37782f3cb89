"""Spelling variants by PartEnum signatures over letter multisets.

A word's letter multiset is a binary vector with one element for each letter and its number of
occurrence. One replaced code point changes two elements at equal length, an inserted or deleted one
changes one element while the lengths differ by one. The elements are dealt to parts; vectors that
differ in at most k elements agree on all but k parts, so the signatures are the enumerated choices of
parts that may be left out, and near words share one. One edit also leaves one half of a word as it
is, so each signature carries that half and is taken over the other. Words meet by equi-join on
signatures and are verified code point by code point.

Defined results: null and empty texts have no words; repeated rows count as often as they occur; equal
counts are decided by code-point order; a null document id counts as the empty text; an empty table
gives an empty result; further columns are ignored. Runs of any length are words like others.
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import ascii_lower, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
DAMAGE = 31
# Parts of a vector. Replaced code points leave out two of them, inserted ones one of two pairs.
PARTS = 4
KEPT_PARTS = {"replaced": tuple(combinations(range(PARTS), PARTS - 2)), "inserted": ((0, 2), (1, 3))}
# A form's count is ten times its word's, so a chain of forms in counts below 2^63 has under 20 links.
DOUBLINGS = 5
_MASK = (1 << 64) - 1


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, damaged where the hash of document and run says so, counted."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0)))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), run.alias("run")).withColumn("run", ascii_lower(F.col("run")))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    hit = (F.col("h") % F.char_length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), hit), F.substring("run", hit + 2, F.char_length("run")))
    return (
        runs.select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))
        .where(F.char_length("word") >= LEAST_LENGTH)
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT))


@lru_cache(1 << 16)
def element(code: int, k: int) -> tuple[int, int]:
    """Part and hash of the k-th occurrence of a letter."""
    return (code + 3 * k) % PARTS, xxhash.xxh64_intdigest(b"%d %d" % (code, k))


def part_digests(text: str) -> list[int]:
    """For each part the sum of the hashes of the text's elements in it."""
    seen: dict[str, int] = {}
    sums = [0] * PARTS
    for letter in text:
        k = seen[letter] = seen.get(letter, 0) + 1
        part, digest = element(ord(letter), k)
        sums[part] += digest
    return sums


def signatures(word: str, short: int, kind: str) -> Iterator[int]:
    """Keys of a word for its near words, where the shorter of the two has length ``short``.

    Two words that agree on one side of the middle of the shorter one differ on the other side only.
    """
    middle = short // 2
    turn = len(word) - (short - middle)
    for side, kept, rest in ((0, word[:middle], word[middle:]), (1, word[turn:], word[:turn])):
        sums = part_digests(rest)
        head = xxhash.xxh64_intdigest(f"{kind} {short} {side} {kept}")
        for number, chosen in enumerate(KEPT_PARTS[kind]):
            key = head + number
            for part in chosen:
                key = (key ^ sums[part]) * 0x9E3779B97F4A7C15 & _MASK
            yield key - (1 << 63)


def _signed(kind: str, shorter_by: int):
    """Rows (key, word, n) of words that stand for the longer of a pair by ``shorter_by``."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            keys = [list(signatures(w, len(w) - shorter_by, kind)) for w in words]
            at = np.repeat(np.arange(len(words)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for own in keys for k in own], pa.int64()),
                 pa.array(words, pa.string()).take(pa.array(at)), pa.array(counts, pa.int64()).take(pa.array(at))],
                names=["key", "word", "n"])
    return sign


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words one edit apart, each once."""
    def signed(kind, shorter_by):
        return counted.mapInArrow(_signed(kind, shorter_by), "key long, word string, n long")

    def met(left, right, order=None):
        a, b = left.alias("a"), right.alias("b")
        near = one_edit(F.col("a.word"), F.col("b.word"))
        joined = a.join(b, (F.col("a.key") == F.col("b.key")) & (near if order is None else order & near))
        return joined.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"),
                             F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))

    same = signed("replaced", 0)
    found = met(same, same, F.col("a.word") < F.col("b.word")).unionByName(
        met(signed("inserted", 0), signed("inserted", 1))).distinct()
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table of texts."""
    counted = stored(words(docs, id_col, text_col), "spelling-words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    told = near_pairs(counted).groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("n").alias("own"), best.alias("best"))
    fits = F.col("best.near_n") >= FORM_FACTOR * F.col("own")
    judged = stored(told.select("word", "n_near", F.when(fits, F.col("best")).alias("best")), "spelling-best")
    forms = judged.where(F.col("best").isNotNull()).select("word", F.col("best.near").alias("root"))
    for _ in range(DOUBLINGS):
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = forms.join(onward, "root", "left")
        if joined.where(F.col("next").isNotNull()).isEmpty():
            break
        forms = stored(joined.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return (
        counted.join(judged, "word", "left").join(forms, "word", "left")
        .select("word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near_n").alias("form_n")))

"""Hard negatives by a secondary-sort shuffle.

An anchor's positives are the rows of its label with the greatest inner products. For each positive
the best rows of other labels are wanted whose score lies in a window just below the positive's.
Scores are computed block by block. The records that can matter, a block's first rows of each window,
travel as packed (anchor, descending score, kind, id) keys through ``repartitionAndSortWithinPartitions``;
a positive sorts before the negatives of its score, so an iterator over a sorted partition opens a
window at each positive, emits the negatives that follow and closes it, holding no anchor's rows.
A block's sixth row of a window can never be among the first five overall: nothing is lost.

Anchors meet all rows by chunk: the chunks are broadcast up to ``MAX_BROADCAST_BYTES``, beyond that
they are joined by (chunk, salt).

Defined results: rows without id, label or vector, or with a null or non-finite component, take no
part. Of rows that share an id the one with the least (label, vector) takes part, so repeated rows
count once. The shorter of two vectors is filled up with zeros; an empty vector scores 0 with all.
Scores beyond a long are clipped to it. Ties go to the smaller id. Anchors without a positive, and
positives without a negative, give no row; an empty table gives an empty result; further columns are
ignored. A vector of any length is one value in one row; it must fit a task's memory.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import stored

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
# A negative may score less than its positive by this part of it, one fifth.
SPARE = 5
ROW_BLOCK, ANCHOR_BLOCK, BLOCK_CELLS = 4096, 1024, 1 << 18
MAX_BROADCAST_BYTES = 32 << 20
_BLOCK = "ids binary, labels binary, vectors binary, bounds binary, dims int"
_KEY = struct.Struct(">QQBQ")
_SIGN, _ALL = 1 << 63, (1 << 64) - 1
OUT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
       "negative_score long")


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  label_col: str = "label") -> DataFrame:
    """(id, label, vector) of the usable rows, one per id, components floored to whole numbers."""
    typed = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = typed.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)
    whole = usable.select("id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))
    return whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    starts = np.asarray(lists.offsets)
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _packed(size: int):
    """Blocks of at most ``size`` rows and ``BLOCK_CELLS`` components, in order of id, as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, width = [], 0, 1
        for batch in batches:
            own = int(np.diff(np.asarray(batch.column("v").offsets)).max(initial=1))
            step = max(1, min(size, BLOCK_CELLS // max(1, own)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                if n and (n + part.num_rows > size or (n + part.num_rows) * max(width, own) > BLOCK_CELLS):
                    yield _block(held)
                    held, n, width = [], 0, 1
                held.append(part)
                n, width = n + part.num_rows, max(width, own)
        if n:
            yield _block(held)
    return pack


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks().sort_by("id")
    column = lambda name: rows.column(name).combine_chunks()
    vectors, bounds = _matrix(column("v")), np.full((rows.num_rows, POSITIVES), -1, dtype=np.int64)
    if "scores" in rows.column_names:
        given = column("scores")
        sizes = np.diff(np.asarray(given.offsets))
        bounds[np.arange(POSITIVES) < sizes[:, None]] = np.asarray(given.flatten())
    cells = [np.asarray(column("id")).tobytes(), np.asarray(column("label")).tobytes(), vectors.tobytes(), bounds.tobytes()]
    return pa.RecordBatch.from_arrays([*[pa.array([c], pa.binary()) for c in cells],
                                       pa.array([vectors.shape[1]], pa.int32())],
                                      names=["ids", "labels", "vectors", "bounds", "dims"])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of two matrices, clipped to a long."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    largest = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (a, b)]
    bound = largest[0] * largest[1] * max(1, dims)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def first_of_rows(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first k allowed cells by descending score, then column."""
    if not scores.shape[1]:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    masked = np.where(allowed, scores, -(1 << 63))
    at = max(0, scores.shape[1] - k)
    row, col = np.nonzero(allowed & (masked >= np.partition(masked, at, axis=1)[:, at:at + 1]))
    # ~x orders as -x does and exists for every long.
    order = np.lexsort((col, ~scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def least(positive):
    """The least score in a positive's window: 80 p <= 100 s is s >= p - floor(p / 5)."""
    return positive - positive // SPARE


def _each_pair(pick):
    """Runs ``pick(scores, anchor labels, row labels, anchor ids, row ids, bounds)`` on block pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                own, tags = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["a_labels"], np.int64)
                bounds = np.frombuffer(r["a_bounds"], np.int64).reshape(len(own), POSITIVES)
                rows = np.frombuffer(r["vectors"], np.int64).reshape(len(ids), r["dims"])
                anchors = np.frombuffer(r["a_vectors"], np.int64).reshape(len(own), r["a_dims"])
                scores = inner_products(anchors, rows)
                i, j = pick(scores, tags[:, None] == labels[None, :], own[:, None] == ids[None, :], bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[i]), pa.array(scores[i, j]), pa.array(ids[j])],
                    names=["anchor", "score", "id"])
    return run


def _positives(scores, same, itself, _bounds):
    return first_of_rows(scores, same & ~itself, POSITIVES)


def _negatives(scores, same, _itself, bounds):
    cells = [np.zeros(0, dtype=np.int64)]
    for k in range(POSITIVES):
        p = bounds[:, k:k + 1]  # a positive below 0 has an empty window, as has the filler
        i, j = first_of_rows(scores, ~same & (p >= 0) & (scores <= p) & (scores >= least(p)), NEGATIVES)
        cells.append(i * scores.shape[1] + j)
    return np.divmod(np.unique(np.concatenate(cells)), max(1, scores.shape[1]))


def _meet(anchors: DataFrame, blocks: DataFrame, chunks: int, size: int, pick) -> DataFrame:
    """(anchor, score, id) that ``pick`` chooses from every anchor chunk and every row block."""
    every = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    packed = anchors.repartition(chunks, "id").mapInArrow(_packed(ANCHOR_BLOCK), _BLOCK).select(
        *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors", "bounds", "dims")],
        F.pmod(F.xxhash64("ids"), F.lit(chunks)).cast("int").alias("chunk"))
    if size <= MAX_BROADCAST_BYTES:
        met = every.join(F.broadcast(packed), "chunk")
    else:
        salts = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // chunks)
        salt = F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")
        met = every.withColumn("salt", salt).join(
            packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["chunk", "salt"])
    return met.mapInArrow(_each_pair(pick), "anchor long, score long, id long")


def packed_key(anchor: int, score: int, positive: bool, other: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives first, id."""
    return _KEY.pack(anchor + _SIGN, _ALL - (score + _SIGN), 0 if positive else 1, other + _SIGN)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, kind, other = _KEY.unpack(key)
    return anchor - _SIGN, _ALL - score - _SIGN, kind == 0, other - _SIGN


def emitted(keys) -> Iterator[tuple]:
    """Result rows from one sorted partition; only the current anchor's open windows are held."""
    current, windows = None, []
    for key, _ in keys:
        anchor, score, positive, other = unpacked(key)
        if anchor != current:
            current, windows = anchor, []
        if positive:
            windows.append([other, score, 0])
            continue
        # A positive below 0 has an empty window.
        windows = [w for w in windows if w[1] >= 0 and w[2] < NEGATIVES and score >= least(w[1])]
        for w in windows:
            w[2] += 1
            yield anchor, w[0], w[2], other, w[1], score


def mine(rows: DataFrame, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """Negatives of every positive of the anchors, the rows whose id ``every`` divides."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(
        whole_vectors(rows, id_col, vec_col, label_col).mapInArrow(_packed(ROW_BLOCK), _BLOCK)
        .select("ids", "labels", "vectors", "dims").repartition(parts, "ids"), "negatives-blocks")
    anchors = stored(whole_vectors(rows.where(F.col(id_col) % every == 0), id_col, vec_col, label_col),
                     "negatives-anchors")
    n, width = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], OUT)
    chunks, size = -(-n // ANCHOR_BLOCK), n * max(1, width) * 8
    best = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    positives = stored(
        _meet(anchors, blocks, chunks, size, _positives)
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= POSITIVES).drop("place"),
        "negatives-positives")
    scores = positives.groupBy(F.col("anchor").alias("id")).agg(
        F.array_sort(F.collect_set("score")).alias("scores"))
    negatives = _meet(anchors.join(scores, "id"), blocks, chunks, size, _negatives)
    keyed = positives.withColumn("kind", F.lit(True)).unionByName(negatives.withColumn("kind", F.lit(False)))
    found = (
        keyed.rdd.map(lambda r: (packed_key(r["anchor"], r["score"], r["kind"], r["id"]), None))
        .repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
        .mapPartitions(emitted))
    return spark.createDataFrame(found, OUT)

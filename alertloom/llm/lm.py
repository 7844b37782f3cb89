"""LM scoring: corpus counts, a gated recurrent model trained on the corpus, whole-text scores.

Token counts cover every training document. The recurrent model knows the ``gru.SYMBOLS - 2`` most
frequent words; the others share one symbol and, below it, their own frequencies, so that every text
has a chance under the model. It learns from every training document once, in ``ROUNDS`` rounds over
hashed parts of them: in a round, replicas of about ``REPLICA_TOKENS`` tokens each are trained, and
averaged by their number of tokens, in groups of ``GROUP`` until one is left. Documents are dealt to
rounds and replicas by hashed id and text and stand there in a fixed order, so the model does not depend
on how the table is partitioned.

Words beyond ``HEAD`` are looked up by a join, so the broadcast stays bounded whatever the vocabulary.

Defined results: null and empty texts are the end token alone; repeated rows are scored each by
itself; without training documents all counts are 0 and the model gives each symbol the same chance;
an empty table gives an empty result; further columns are ignored. Texts of any length are read whole;
one text must fit a task's memory.
"""

import math
from contextlib import contextmanager
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import gru
from alertloom.llm.common import ascii_lower, cut_lineage, stored

END = "\n"  # no word holds white space
HEAD = 1 << 15  # most frequent words whose counts every worker holds; their places fit 16 bits
ROUNDS, REPLICA_TOKENS, GROUP = 3, 1_000_000, 64
BUFFER_TOKENS = 4_000_000  # symbols that a worker scores at a time
CHUNK = 4096  # parameters in one row of a replica
COUNTED = 4_000_000  # words that a worker counts at a time


class Corpus(NamedTuple):
    """Frequent words by place in order of frequency, their counts, and the sums over all tokens."""

    places: dict[bytes, int]
    counts: np.ndarray
    ends: int
    n: int
    v: int
    rest_n: int
    rest_v: int


UNKNOWN, LAST = 0, 1  # symbols of all other words and of the end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one text after the other, and the number of the text of each."""
    texts = pc.cast(texts, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, which = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists))
    real = pc.not_equal(words, "")
    return words.filter(real), which[real.to_numpy(zero_copy_only=False)]


def token_counts(train: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all whole training texts, the end token included."""
    return (train.select(F.col(text_col).alias("text")).mapInArrow(_counted, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _counted(batches):
    """Numbers of words among each ``COUNTED`` that a worker reads, and of ends."""
    held, size, ends = [], 0, 0

    def rows():
        found = pc.value_counts(pa.chunked_array(held, pa.string()))
        return pa.record_batch([found.field("values"), found.field("counts")], ["word", "n"])

    for batch in batches:
        held.append(words_of(batch.column(0))[0])
        size, ends = size + len(held[-1]), ends + batch.num_rows
        if size > COUNTED:
            yield rows()
            held, size = [], 0
    yield rows()
    if ends:
        yield pa.record_batch([pa.array([END]), pa.array([ends], pa.int64())], ["word", "n"])


def corpus_of(counts: DataFrame) -> Corpus:
    """The bounded head of the counts, the HEAD most frequent words, and the sums over all."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = counts.where(F.col("word") == END).first()
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(HEAD).collect()
    known = {r["word"].encode(): k for k, r in enumerate(top)}
    found = np.array([r["n"] for r in top], dtype=np.int64)
    n, v, end = total["n"] or 0, total["v"], ends["n"] if ends else 0
    modelled = found[:gru.SYMBOLS - 2]
    return Corpus(known, found, end, n, v, n - int(modelled.sum()) - end, v - len(modelled) - (1 if ends else 0))


def symbols(at: np.ndarray) -> np.ndarray:
    """Symbols of words by their places, and the end."""
    out = np.empty(len(at) + 1, dtype=np.int32)
    out[:-1], out[-1] = at, LAST
    own = out[:-1]
    own += 2
    own[(at < 0) | (at >= gru.SYMBOLS - 2)] = UNKNOWN
    return out


# Classes hold symbols in order of frequency, so the two special symbols stand first.
def first_params(corpus: Corpus) -> gru.Params:
    counts = np.zeros(gru.SYMBOLS)
    counts[UNKNOWN], counts[LAST] = corpus.rest_n, corpus.ends
    modelled = corpus.counts[:gru.SYMBOLS - 2]
    counts[2:2 + len(modelled)] = modelled
    return gru.initial(counts)


def train(coded: DataFrame, corpus: Corpus, rounds: int = ROUNDS, replica_tokens: int = REPLICA_TOKENS) -> gru.Params:
    """Parameters after the rounds of replica training and averaging over the coded rows (h, places)."""
    spark = coded.sparkSession
    params = first_params(corpus)
    if not corpus.n:
        return params
    replicas = max(1, round(corpus.n / rounds / replica_tokens))
    coded = coded.select(F.pmod("h", F.lit(rounds)).cast("int").alias("round"),
                         F.pmod(F.shiftright("h", 20), F.lit(replicas)).alias("replica"), "h", "places")
    for k in range(rounds):
        rows = coded.where(F.col("round") == k).drop("round")
        shared = spark.sparkContext.broadcast(gru.flat(params))
        vectors = (rows.repartitionByRange(min(replicas, 4096), "replica")
                   .sortWithinPartitions("replica", "h", "places")
                   .mapInArrow(_replica(shared), "chunk int, replica long, weight double, vec array<float>"))
        left = replicas
        while True:
            left = -(-left // GROUP)
            vectors = (vectors.withColumn("group", F.expr(f"replica div {GROUP}")).groupBy("chunk", "group")
                       .applyInPandas(_weighted_sum, "chunk int, replica long, weight double, vec array<float>"))
            if left == 1:
                break
        sums = sorted(vectors.collect(), key=lambda r: r["chunk"])
        shared.unpersist()
        if sums and sums[0]["weight"] > 0:
            params = gru.unflat(np.concatenate(
                [np.array(r["vec"], dtype=np.float64) / r["weight"] for r in sums]))
    return params


CODED = "h long, places binary, rare array<struct<word:string,n:int>>, doc_id long, held_out boolean"


def _coded(known):
    """Texts (hash, text, further columns) as places of their words, -1 for those beyond the head, and numbers of
    these."""
    def run(batches):
        head = pa.array(known.value.places, pa.binary()).cast(pa.string())
        for batch in batches:
            words, which = words_of(batch.column(1))
            at, texts = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy().astype(np.int16), np.arange(batch.num_rows + 1)
            stops = np.searchsorted(which, texts).astype(np.int32) * np.int32(at.itemsize)
            placed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(stops), pa.py_buffer(at)])
            coded = words.filter(pa.array(at < 0)).dictionary_encode()
            distinct = max(1, len(coded.dictionary))
            keys, n = np.unique(which[at < 0] * distinct + coded.indices.to_numpy(), return_counts=True)
            text, word = np.divmod(keys, distinct)
            pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(n, pa.int32())], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, texts), pa.int32()), pairs)
            yield pa.record_batch([batch.column(0), placed, rare, *batch.columns[2:]],
                                  ["h", "places", "rare", *batch.schema.names[2:]])
    return run


def _replica(shared):
    """Trained parameters of each replica, whose rows stand together, in chunks times tokens seen."""
    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches):
        for replica, own in groupby(rows(batches), key=lambda r: r[0]):
            trainer, seen, held, size = gru.Trainer(gru.unflat(shared.value)), 0, [], 0
            for _, _, coded in own:
                held.append(symbols(np.frombuffer(coded, dtype=np.int16)))
                size += len(held[-1])
                if size > BUFFER_TOKENS:
                    seen += trainer.learn(held, LAST)
                    held, size = [], 0
            seen += trainer.learn(held, LAST)
            vector = gru.flat(trainer.p)
            chunks = [vector[a:a + CHUNK] * np.float32(seen) for a in range(0, len(vector), CHUNK)]
            n = len(chunks)
            yield pa.record_batch(
                [pa.array(range(n), pa.int32()), pa.array([replica] * n, pa.int64()),
                 pa.array([float(seen)] * n), pa.array(chunks, pa.list_(pa.float32()))],
                ["chunk", "replica", "weight", "vec"])
    return run


def _weighted_sum(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of at most GROUP chunks, in a fixed order."""
    rows = rows.sort_values("replica")
    total = np.sum(np.stack(rows["vec"].to_list()).astype(np.float64), axis=0)
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "replica": [rows["group"].iloc[0]],
                         "weight": [rows["weight"].sum()], "vec": [total.astype(np.float32)]})


PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, score_part double"


def _scorer(shared, known):
    def run(batches):
        params, corpus, held, size = gru.unflat(shared.value), known.value, [], 0
        for batch in batches:
            for row, doc, out, coded in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append((row, doc, out, np.frombuffer(coded, dtype=np.int16)))
                size += len(held[-1][-1]) + 1
                if size > BUFFER_TOKENS:
                    yield _scored(params, corpus, held)
                    held, size = [], 0
        if held:
            yield _scored(params, corpus, held)
    return run


def _scored(params, corpus: Corpus, held: list[tuple]) -> pa.RecordBatch:
    """Sums over the tokens that the worker knows; the others are handed on with their numbers."""
    rows, docs, out, at = zip(*held)
    model = gru.score(params, [symbols(a) for a in at], LAST)
    sizes = np.array([len(a) for a in at])
    flat, which = np.concatenate(at), np.repeat(np.arange(len(at)), sizes)
    # The last place, -1, stands for the words beyond the head: nothing is added for them here.
    logs = np.append(np.log10(corpus.counts + 0.5), 0.0)[flat]
    unknown = (flat < 0) | (flat >= gru.SYMBOLS - 2)
    sums = lambda weights: np.bincount(which, weights, len(at))
    rest = math.log10(corpus.rest_n + 0.5 * (corpus.rest_v + 1))
    # Words that share the unknown symbol add their chance among the rest.
    score = model + sums(np.where(unknown, logs - rest, 0.0))
    return pa.record_batch(
        [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(out, pa.bool_()), pa.array(sizes + 1, pa.int64()),
         pa.array(sums(flat >= 0).astype(np.int64) + (corpus.ends > 0)),
         pa.array(sums(logs) + math.log10(corpus.ends + 0.5)), pa.array(score)],
        [field.split()[0] for field in PARTS.split(", ")])


@contextmanager
def _small_parts_hashed(spark: SparkSession):
    """Joins whose parts all turn out small are made by hashing; others are sorted and merged as always."""
    key, size = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, spark.conf.get(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          rounds: int = ROUNDS, replica_tokens: int = REPLICA_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Rows where ``held_out`` is false are the training documents.
    """
    context = docs.sparkSession.sparkContext
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"),
                         F.col(text_col).alias("text"))
    train_docs = marked.where(~F.col("held_out"))
    counts = stored(token_counts(train_docs, "text"), "lm-counts")
    corpus = corpus_of(counts)
    known = context.broadcast(corpus)
    # Texts are taken apart once; training and scoring read what is stored here.
    h = F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary"))
    coded = stored(marked.select(h.alias("h"), "text", "doc_id", "held_out")
                   .mapInArrow(_coded(known), CODED).withColumn("row", F.monotonically_increasing_id()), "lm-places")
    shared = context.broadcast(gru.flat(train(coded.where(~F.col("held_out")), corpus, rounds, replica_tokens)))
    parts = cut_lineage(coded.select("row", "doc_id", "held_out", "places").mapInArrow(_scorer(shared, known), PARTS))
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    n = F.coalesce("c", F.lit(0))
    found = (rare.join(counts.select("word", F.col("n").alias("c")), "word", "left")
             .groupBy("row").agg(F.sum(F.col("n") * F.log10(n + 0.5)).alias("rare_log"),
                                 F.sum(F.when(n > 0, F.col("n")).otherwise(0)).alias("rare_known")))
    with _small_parts_hashed(docs.sparkSession):
        found = stored(found, "lm-rare")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    unit = math.log10(corpus.n + 0.5 * (corpus.v + 1))
    return parts.join(found, "row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.n).cast("long").alias("train_tokens"),
        (F.col("base_part") + rare_log - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("score_part") + rare_log).alias("score"))

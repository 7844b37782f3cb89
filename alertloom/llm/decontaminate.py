"""Benchmark decontamination: prefix-filtered set join with exact windows.

Item texts are cut into windows of 13 consecutive words (a shorter item is one window) and windows
into shingles of a few words. A window can only occur where all its shingles do, so one of them, the
rarest in the documents, is its necessary prefix: documents are joined on that token only. Length and
position bounds drop starts that do not fit into the document. What is left is verified exactly: all
other shingles must stand at their offsets, and shingles are compared by their words.

Only built-in functions run here. The documents are read once; from then on only positions of
shingles that some item has are kept.

Defined results: null and wordless texts have no words and are clean; rows that repeat a doc_id are
one document if their texts are equal (reported once per row), else told apart by text; items with
the same text or id count as one item per item_id; empty tables give no hits or an empty result.
Texts of any length are read whole; further columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import ascii_lower, cut_lineage, free_name

WINDOW = 13
SHINGLE = 4
MAX_BROADCAST_ROWS = 500_000  # of item shingles, 16 bytes each; more are joined by shuffle
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.array_remove(parts, "")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(window_id, size, shingles, item_ids): distinct windows, with the items that have them."""
    ws = items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    starts = F.expr(f"sequence(1, greatest(1, size(w) - {window - 1}))")
    return (
        ws.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("start"))
        .select("item_id", F.slice("w", F.col("start"), F.lit(window)).alias("window"))
        .groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
        .withColumn("size", F.size("window"))
        .withColumn("k", F.least(F.col("size"), F.lit(SHINGLE)))
        .withColumn("shingles", F.expr(
            "transform(sequence(1, size - k + 1), i -> concat_ws(' ', slice(window, i, k)))"))
        .withColumn("window_id", F.monotonically_increasing_id())
        .select("window_id", "size", "k", "shingles", "item_ids")
    )


def shingle_hits(docs: DataFrame, tokens: DataFrame, lengths: list[int], id_col: str,
                 text_col: str, broadcast: bool) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, token_id): item shingles at their places, one scan.

    Every document also keeps one row without a place, which carries its word count.
    """
    span = max(lengths)
    ws = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                     words(F.col(text_col)).alias("w"))
    ws = ws.withColumn("n_words", F.size("w").cast("long"))
    shifted = [F.col("w")] + [F.slice("w", F.lit(i + 1), F.greatest(F.size("w"), F.lit(1)))
                              for i in range(1, span)]
    named = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])
    at = ws.select("doc_id", "text_hash", "n_words", F.posexplode_outer(named).alias("pos", "z"))
    cols = [F.col("z").getField(f"w{i}") for i in range(span)]
    at = at.select("doc_id", "text_hash", "n_words", "pos",
                   *[c.alias(f"w{i}") for i, c in enumerate(cols)])
    if len(lengths) == 1:
        places = at.withColumn("k", F.lit(lengths[0]))
    else:  # items shorter than a shingle need tokens of their own length
        places = at.withColumn("k", F.explode(F.array(*[F.lit(k) for k in lengths])))
    key = F.lit(None).cast("long")
    for k in lengths:
        whole = (F.col("k") == k) & F.col(f"w{k - 1}").isNotNull()
        key = F.when(whole, F.xxhash64(F.lit(k), *[f"w{i}" for i in range(k)])).otherwise(key)
    places = places.withColumn("key", key)
    side = F.broadcast(tokens) if broadcast else tokens
    text = F.lit(None).cast("string")
    for k in lengths:
        text = F.when(F.col("k") == k, F.concat_ws(" ", *[f"w{i}" for i in range(k)])).otherwise(text)
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return (
        places.join(side, ["key"], "left")
        .withColumn("token_id", F.when(F.col("token") == text, F.col("token_id")))
        .where(F.col("token_id").isNotNull() | (first & (F.col("k") == lengths[0])))
        .select("doc_id", "text_hash", "n_words", "pos", "token_id",
                (first & (F.col("k") == lengths[0])).alias("is_first"))
    )


def tokens_of(windows: DataFrame) -> DataFrame:
    """(key, token, token_id) of all shingles of the windows.

    The key is the hash by which documents look a shingle up; shingles whose hashes collide are
    separate rows, and the words decide.
    """
    shingles = windows.select("k", F.explode("shingles").alias("token")).distinct()
    parts = F.split("token", " ")
    key = F.lit(None).cast("long")
    for k in range(1, SHINGLE + 1):
        key = F.when(F.col("k") == k, F.xxhash64(F.lit(k), *[
            F.get(parts, F.lit(i)) for i in range(k)])).otherwise(key)
    return shingles.select(key.alias("key"), "token", F.xxhash64("token", F.lit(7)).alias("token_id"))


def occurrences(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, size, item_ids): verified places of windows."""
    hits = hits.where(F.col("token_id").isNotNull()).select(
        "doc_id", "text_hash", "n_words", F.col("pos").cast("long").alias("pos"), "token_id")
    counts = hits.groupBy("token_id").agg(F.count("*").alias("n"))
    steps = windows.select("window_id", F.posexplode("shingles").alias("offset", "token")).select(
        "window_id", "offset", F.xxhash64("token", F.lit(7)).alias("token_id"))
    # Rarest shingle of each window; one that the documents lack rules the window out.
    rarest = (
        steps.join(counts, "token_id", "left").groupBy("window_id").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token_id")).alias("r"))
        .where("r.n > 0").select("window_id", "r.offset", "r.token_id"))
    prefix = rarest.join(windows.select("window_id", "size"), "window_id")
    start = F.col("pos") - F.col("offset")
    starts = (hits.join(prefix, "token_id").withColumn("start", start)
              .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
              .select("doc_id", "text_hash", "window_id", "start"))
    wanted = (starts.join(steps, "window_id")
              .withColumn("pos", F.col("start") + F.col("offset")).drop("offset"))
    here = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "pos", "token_id"
                       ).distinct()
    found = wanted.join(here, F.expr("doc_id <=> d") & (F.col("text_hash") == F.col("h"))
                        & (wanted["pos"] == here["pos"])
                        & (wanted["token_id"] == here["token_id"]))
    whole = (
        found.groupBy("doc_id", "text_hash", "window_id", "start").agg(
            F.countDistinct(wanted["pos"]).alias("n"))
        .join(windows.select("window_id", "size", "item_ids", F.size("shingles").alias("need")),
              "window_id"))
    return whole.where("n = need").select("doc_id", "text_hash", "start", "size", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated), one row per row of ``docs``."""
    windows = cut_lineage(item_windows(items, item_col, item_text_col))
    tokens = cut_lineage(tokens_of(windows))
    lengths = [r.k for r in windows.select("k").distinct().orderBy(F.desc("k")).collect()] or [SHINGLE]
    small = tokens.count() <= MAX_BROADCAST_ROWS
    hits = cut_lineage(shingle_hits(docs, tokens, lengths, id_col, text_col, small))
    places = occurrences(hits, windows)
    doc = W.partitionBy("doc_id", "text_hash").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(doc.rowsBetween(W.unboundedPreceding, -1))
    covered = places.withColumn("reach", F.coalesce(reach, F.lit(0))).withColumn(
        "new", F.greatest(F.lit(0), F.col("start") + F.col("size")
                          - F.greatest("start", "reach")))
    by_doc = covered.groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"))
    by_item = (places.select("doc_id", "text_hash", F.explode("item_ids").alias("item_id"))
               .groupBy("doc_id", "text_hash").agg(
                   F.array_sort(F.collect_set("item_id")).alias("items")))
    marked = by_doc.join(by_item, F.expr("true") & by_doc["doc_id"].eqNullSafe(by_item["doc_id"])
                         & (by_doc["text_hash"] == by_item["text_hash"])).select(
        by_doc["doc_id"].alias("d"), by_doc["text_hash"].alias("h"), "n_hit", "items")
    rows = hits.where("is_first").select("doc_id", "text_hash", "n_words")
    hit = F.coalesce("n_hit", F.lit(0))
    return (
        # A first word that starts several kinds of shingles must not repeat its document.
        rows.join(marked, F.expr("doc_id <=> d") & (F.col("text_hash") == F.col("h")), "left")
        .select(F.col("doc_id").alias(id_col), "text_hash", "n_words", hit.cast("long").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))
    )


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated; columns as they came."""
    bad_id, bad_hash = free_name(docs, "bad_id"), free_name(docs, "bad_hash")
    plain = docs.select(F.col(id_col), F.col(text_col))
    bad = (contamination(plain, items, id_col, text_col).where("contaminated")
           .select(F.col(id_col).alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id))
                     & (F.xxhash64(text_col) == F.col(bad_hash)), "left_anti")

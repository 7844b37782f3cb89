"""Licence scans: canonical digests of entire texts looked up among digests of known licences.

Case, punctuation, copyright lines and equivalent spellings are normalised away; what remains is
digested and joined with the digests of known texts, the entire texts of published licences and their
usual one-line notices. Whole documents are looked up, and each line of a document by itself, so that a
one-line notice inside other text is found as well. Only lines that hold a word of some known text, one
that no other spelling leads to, can be one of them; only those are made canonical.

Defined results: a null, empty or letterless text has no digest and no licence; repeated rows are
looked up each by itself; an empty table gives an empty result; further columns are ignored. Texts of any
length are read whole.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.license_texts import KNOWN, SPELLINGS

# A line that only states who holds the copyright since when, in any order, or that all rights are reserved.
HOLDER = (r"(?im)^[ \t*#/;-]*((copyright|\(c\))[^\n]*([0-9]{4}|<year>|\[year\])|copyright[ \t]*(\(c\)|©)|©"
          r"|all rights reserved)[^\n]*$")
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower-case words with single spaces between them, without copyright lines."""
    # Two spaces between words, so that each has its own on both sides and neighbours are replaced alike.
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, HOLDER, " ")), MARKS, "  ")
    bare = F.concat(F.lit(" "), F.trim(bare), F.lit(" "))
    for variant, usual in SPELLINGS:
        variant, usual = (f" {words} ".replace(" ", "  ")[1:-1] for words in (variant, usual))
        bare = F.replace(bare, F.lit(variant), F.lit(usual))
    return F.trim(F.replace(bare, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """sha256 of the canonical text; null if nothing remains of it."""
    kept = canonical(text)
    return F.when(kept != "", F.sha2(kept.cast("binary"), 256))


def known_texts(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license_id, license_digest, canonical) of the known texts, one row per digest."""
    rows = spark.createDataFrame(list((known or KNOWN).items()), "license_id string, body string")
    return (rows.select("license_id", digest(F.col("body")).alias("license_digest"),
                        canonical(F.col("body")).alias("canonical"))
            .groupBy("license_digest").agg(F.min("license_id").alias("license_id"),
                                           F.first("canonical").alias("canonical")))


def keywords(texts: list[str]) -> list[str]:
    """Words of which every text holds one as it stands; none if that cannot be said of some text."""
    led_to = {w for _, usual in SPELLINGS for w in usual.split()}
    found = set()
    for text in texts:
        own = [w for w in text.split() if re.fullmatch("[a-z]+", w) and w not in led_to]
        if not own:
            return []
        found.add(max(own, key=lambda w: (len(w), w)))
    return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         known: dict[str, str] | None = None) -> DataFrame:
    """(id, text_digest, license_id, notices): licence of the entire text and of single lines.

    The known digests are a fixed list of this package or the caller's, so they are broadcast.
    """
    fixed = known_texts(docs.sparkSession, known).collect()  # the fixed list, some forty rows
    table = F.broadcast(docs.sparkSession.createDataFrame(
        [(r["license_id"], r["license_digest"]) for r in fixed], "license_id string, license_digest string"))
    units = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = units.withColumn("text_digest", digest(F.col("text"))).join(
        table, F.col("text_digest") == F.col("license_digest"), "left").drop("license_digest")
    # Lines are looked up in the row, in a literal map of the fixed list: no line leaves its document.
    pairs = F.create_map(*[F.lit(x) for r in fixed for x in (r["license_digest"], r["license_id"])])
    words = keywords([r["canonical"] for r in fixed])
    lines = F.split("text", "\n")
    if words:
        lines = F.filter(lines, lambda line: F.lower(line).rlike("|".join(words)))
    found = F.transform(lines, lambda line: F.element_at(pairs, F.sha2(canonical(line).cast("binary"), 256)))
    notices = F.array_sort(F.array_distinct(F.array_compact(found)))
    return whole.select(
        F.col("id").alias(id_col), "text_digest", "license_id",
        F.coalesce(F.array_join(notices, ","), F.lit("")).alias("notices"))

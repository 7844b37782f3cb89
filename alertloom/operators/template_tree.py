"""Log templates by similarity: a fixed-depth prefix tree and merging in every leaf.

The entries of the tree are masked messages. A leaf holds the templates of one length that share two tokens at
fixed places, so the tree is a grouping key and needs no nodes. In each leaf the most frequent template
is the representative; those that agree with it on at least ``SIMILARITY`` percent of their tokens merge with it,
and every token in which one of them differs becomes a wildcard. Merging is repeated with other places
in the key, so that a varying first token does not keep templates apart for good. Tokens are compared
within joined rows; only differing positions are exploded, and a leaf of any size meets its one
representative row, never itself.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.operators.templates import WILDCARD, mask_sql, masked_templates, template_id_sql
from alertloom.session import stored

# Fixed value: the usual threshold of prefix-tree miners, in percent of the tokens.
SIMILARITY = 40
# Places of the two key tokens in each round, from the front (0, 1) or the back (-1, -2).
PLACES = ((0, 1), (-2, -1), (0, -1))


def _token(place: int) -> str:
    """The token at a place; templates shorter than two tokens never get here."""
    return f"element_at(words, {place + 1 if place >= 0 else place})"


def merge_round(templates: DataFrame, places: tuple[int, int], similarity: int = SIMILARITY) -> DataFrame:
    """(template, merged) of the templates that one round changes, of rows (template, n)."""
    spaced = templates.selectExpr("template", "n", "split(template, ' ') AS words").where("size(words) > 1").selectExpr(
        "template", "n", "size(words) AS length", *[f"{_token(p)} AS key{k}" for k, p in enumerate(places)])
    leaf = ["length", "key0", "key1"]
    # Most leaves hold one template; the texts of those go no further.
    shared = spaced.groupBy(*leaf).agg(F.count("*").alias("members")).where("members > 1").select(*leaf)
    entries = spaced.join(shared, leaf, "left_semi")
    heads = entries.groupBy(*leaf).agg(F.min(F.struct((-F.col("n")).alias("rank"), "template")).alias("first")).select(
        *leaf, F.col("first.template").alias("head"))
    odd = ("filter(transform(arrays_zip(split(template, ' '), split(head, ' ')), "
           "(t, i) -> if(t.`0` <=> t.`1`, NULL, i)), i -> i IS NOT NULL)")
    near = (entries.join(heads, leaf)
            .selectExpr("template", "head", f"{template_id_sql('head')} AS head_id", "length", f"{odd} AS odd")
            .where(f"100 * (length - size(odd)) >= {similarity} * length"))
    # At most one number per token of the representative.
    varying = (near.selectExpr("head_id", "explode(odd) AS i").distinct()
               .groupBy("head_id").agg(F.collect_set("i").alias("varying")))
    return (
        near.select("template", "head", "head_id").join(varying, "head_id").selectExpr(
            "template",
            f"array_join(transform(split(head, ' '), (t, i) -> if(array_contains(varying, i), "
            f"'{WILDCARD}', t)), ' ') AS merged"))


def _ends(found: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(template_id, now) of all templates, and (now, merged) of what they end in.

    Templates are known by their ids between the rounds, and each round is stored once, compressed.
    """
    labels = found.selectExpr("template_id", "template_id AS now")
    current = found.selectExpr("template_id AS now", "template", "n")
    for places in PLACES:
        changed = stored(merge_round(current.select("template", "n"), places, similarity).selectExpr(
            f"{template_id_sql('template')} AS now", f"{template_id_sql('merged')} AS next", "merged"), "template-changes")
        labels = labels.join(changed.select("now", "next"), "now", "left").selectExpr(
            "template_id", "coalesce(next, now) AS now")
        after = current.join(changed, "now", "left").selectExpr(
            "coalesce(next, now) AS now", "coalesce(merged, template) AS template", "n")
        current = stored(after.groupBy("now", "template").agg(F.sum("n").alias("n")), "templates")
    return labels, current.selectExpr("now", "template AS merged")


def _found(masked: DataFrame) -> DataFrame:
    return stored(masked.select("template_id", "template", "n"), "templates")


def similar_templates(masked: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Every masked template with the merged template it ends in.

    ``masked`` has a row (template_id, template, n) for each masked template.
    """
    labels, ends = _ends(_found(masked), similarity)
    return labels.join(ends, "now").selectExpr("template_id", "now AS merged_id", "merged")


def mined_templates(messages: DataFrame, message: str = "message") -> DataFrame:
    """Merged templates with an id, the number of messages and of masked variants."""
    found = _found(masked_templates(messages, message))
    labels, ends = _ends(found, SIMILARITY)
    counts = (labels.join(found.select("template_id", "n"), "template_id")
              .groupBy("now").agg(F.sum("n").alias("n"), F.count("*").alias("variants")))
    return counts.join(ends, "now").selectExpr("now AS template_id", "merged AS template", "n", "variants")


def labelled_messages(messages: DataFrame, message: str = "message") -> DataFrame:
    """Every message with ``template_id`` and ``template``; a null message has none.

    Messages meet their templates by the id of their masked text, so no text is shuffled. They are read
    twice: once to mine the templates, once to label.
    """
    merged = similar_templates(masked_templates(messages, message))
    keyed = messages.withColumn("_masked_id", F.expr(template_id_sql(mask_sql(message))))
    return (keyed.join(merged.selectExpr("template_id AS _masked_id", "merged_id AS template_id",
                                         "merged AS template"), "_masked_id", "left")
            .drop("_masked_id"))

"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``MOST`` that stays as near to 1 (in relative entropy) as
the token constraints of the sources allow. The solution is an exponential tilt by document size,

    rate = MOST * q * exp(l * size) / (1 - q + q * exp(l * size)),   q = 1 / MOST,

with one multiplier ``l`` per source: the root of the gradient of a convex dual function. Newton's
method finds it for all sources at once; a bracket catches steps that overshoot. Documents of one
source and size have one rate, so the iterations run over (source, size, documents), which grows
with the number of different sizes and not with the documents. Rates become whole copies per cell;
what rounding leaves over is dealt out by hashed priority and then by size.

Defined results: null text has size 0, takes nothing and keeps its row; null is a source of its own,
last in order; repeated rows are mixed as rows of their own; an empty table gives an empty result.
Texts of any length count whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import WORD, cut_lineage, free_name

MOST = 3  # copies of a document at most
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
BATCHES, STEPS = 8, 5  # Newton steps are planned STEPS at a time; the loop ends when all have met
TOLERANCE = 1e-7
SALT = 256  # parts into which the documents of a cell are split for ranking


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """(id, source, size, text_hash): words of every text."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       _size_of(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))


def _size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target), one row per source.

    Shares by weight, stopped at MOST times the source's own size; the excess is shared again. The
    end of this is a level: target = least of the limit and level * weight. Sources sorted by limit
    per weight stop one after the other, so running sums find the level. The windows see one row
    per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = per_source.withColumn("weight", F.element_at(
        cycle, (place % len(weights) + 1).cast("int"))).withColumn(
        "limit", F.lit(float(MOST)) * F.col("source_size"))
    order = everything.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("stopped")) / F.col("open"))
    )
    # The level is that of the first source that does not stop.
    free = F.when(F.col("level_here") * F.col("weight") <= F.col("limit"), F.col("level_here"))
    level = F.first(free, ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    share = F.least(F.col("limit"), level * F.col("weight"))
    return rows.select("source", "source_size",
                       F.coalesce(share, F.col("limit")).alias("target"))


def _rate(tilt: Column) -> Column:
    """Tilted rate; written so that large exponents do not overflow."""
    grown = F.exp(F.least(tilt, F.lit(700.0)))
    return MOST * grown / (F.lit(MOST - 1.0) + grown)


def multipliers(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, mean, tilt): Newton's method on the dual, all sources in each distributed step."""
    state = cut_lineage(
        goals.join(cells.groupBy(F.col("source").alias("s")).agg(
            (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean")),
            F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("mean", F.greatest("mean", F.lit(1e-9)))
        # A source that gives all it may needs no search: its rate is the greatest for every size.
        .withColumns({"tilt": F.when(F.col("target") >= (1 - 1e-12) * MOST * F.col("source_size"), 1e4)
                      .otherwise(0.0), "low": F.lit(-1e4), "high": F.lit(1e4),
                      "gap": F.lit(None).cast("double")}))
    for _ in range(BATCHES):
        for _ in range(STEPS):
            state = _newton_step(cells, state)
        state = cut_lineage(state)
        if state.agg(F.max("gap")).first()[0] in (None, 0.0):
            break
    return state.select("source", "mean", "tilt")


def _newton_step(cells: DataFrame, state: DataFrame) -> DataFrame:
    """One step of every source: gradient and curvature over the cells, then the safeguarded move."""
    keep = ["source", "source_size", "target", "mean", "tilt", "low", "high"]
    at = cells.withColumnRenamed("source", "s").join(state, F.col("s").eqNullSafe(F.col("source")))
    scaled = F.col("size") / F.col("mean")
    rate = _rate(F.col("tilt") * scaled)
    weight = F.col("n") * F.col("size")
    sums = at.groupBy(*keep).agg(
        F.sum(weight * rate).alias("taken"),
        F.sum(weight * scaled * rate * (1 - rate / MOST)).alias("slope"))
    gap = F.col("taken") - F.col("target")
    met = (F.abs(gap) <= TOLERANCE * F.greatest("target", F.lit(1.0))) | (F.col("tilt") >= 9e3)
    low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
    moved = F.when(F.col("slope") > 0, F.col("tilt") - gap / F.col("slope"))
    # Newton inside the bracket and not too far at once, else halve the bracket.
    near = F.greatest(F.lit(4.0), 2 * F.abs("tilt"))
    safe = (moved > F.col("low2")) & (moved < F.col("high2")) & (F.abs(moved - F.col("tilt")) <= near)
    jump = F.greatest(F.col("low2"), F.least(F.col("high2"), F.col("tilt") - F.signum(gap) * near))
    halfway = F.when((F.col("low2") > -1e4) & (F.col("high2") < 1e4),
                     (F.col("low2") + F.col("high2")) / 2).otherwise(jump)
    return (
        sums.withColumn("low2", low).withColumn("high2", high)
        .withColumn("next", F.when(met, F.col("tilt")).when(safe, moved).otherwise(halfway))
        .withColumn("gap", F.when(met | (F.abs("next") >= 9e3), F.lit(0.0)).otherwise(F.abs(gap)))
        .select("source", "source_size", "target", "mean", F.col("next").alias("tilt"),
                F.col("low2").alias("low"), F.col("high2").alias("high"), "gap")
    )


def cell_copies(cells: DataFrame, goals: DataFrame, tilts: DataFrame) -> DataFrame:
    """(source, size, each, extra): copies of every document of a cell, and documents with one more.

    Whole copies of a cell are its expected copies rounded down. The tokens that still lack are
    filled with single further copies: first cells by hashed priority in proportion to what was cut
    off, then, in three passes, the largest cells that fit the rest. Windows see the cells of a
    source, at most one per different size.
    """
    at = (cells.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
          .drop("s"))
    at = (at.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
          .drop("s"))
    expected = F.col("n") * _rate(F.col("tilt") * F.col("size") / F.col("mean"))
    chance = F.pmod(F.xxhash64("source", "size"), F.lit(1 << 20)) / float(1 << 20)
    rows = (
        at.withColumn("expected", expected)
        .withColumn("copies", F.least(F.floor(F.col("expected") + 1e-9), F.col("n") * MOST))
        .withColumn("cut", F.greatest(F.col("expected") - F.col("copies"), F.lit(0.0)))
        .withColumn("urge", (chance + 1e-9) / F.greatest("cut", F.lit(1e-12)))
    )
    source = W.partitionBy("source")
    running = lambda *by: source.orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    free = (F.col("copies") < F.col("n") * MOST) & (F.col("size") > 0)
    for k, by in enumerate([("urge", "size")] + [(F.desc("size"),)] * 3):
        lacks = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(source)
        fits = free & (F.col("size") <= F.col("lacks"))
        if k == 0:  # only cells that were cut; later passes take any with room
            fits = fits & (F.col("cut") > 0)
        rows = (
            rows.withColumn("lacks", lacks)
            .withColumn("try", F.when(fits, F.col("size")).otherwise(0))
            .withColumn("upto", F.sum("try").over(running(*by)))
            .withColumn("copies", F.col("copies") + F.when(
                (F.col("try") > 0) & (F.col("upto") <= F.col("lacks")), 1).otherwise(0))
        )
    return rows.select("source", "size", F.floor(F.col("copies") / F.col("n")).alias("each"),
                       (F.col("copies") % F.col("n")).cast("long").alias("extra"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(id, size, source, source_size, target, copies, taken), one row per row of ``docs``."""
    return _hashed_mix(docs, id_col, text_col, source_col).drop("text_hash")


def _hashed_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The mix with ``text_hash``, which tells rows of one id and size apart."""
    sizes = cut_lineage(sized(docs, id_col, text_col, source_col))
    cells = cut_lineage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = cut_lineage(targets(sizes))
    plan = cut_lineage(cell_copies(cells, goals, multipliers(cells, goals)))
    # Rank the documents of a cell: parts of hashed ids, each part ranked by itself behind an offset.
    part = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
    ranked = sizes.withColumn("part", part).withColumn("at", F.row_number().over(
        W.partitionBy("source", "size", "part").orderBy(F.xxhash64("id", F.lit(1)), "id", "text_hash")))
    parts = sizes.groupBy("source", "size", part.alias("part")).agg(F.count("*").alias("n"))
    offsets = parts.withColumn("before", F.sum("n").over(
        W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
        - F.col("n"))
    marks = offsets.alias("o").join(plan.alias("p"), F.expr(
        "o.source <=> p.source AND o.size = p.size")).selectExpr(
        "o.source AS s", "o.size AS z", "o.part AS q", "before", "each", "extra")
    marks = (marks.join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    copies = F.col("each") + F.when(F.col("at") + F.col("before") <= F.col("extra"), 1).otherwise(0)
    return (
        ranked.join(marks, F.expr("source <=> s AND size = z AND part = q"))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
        .select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, once each, with ``copies``: how often it takes them.

    Rows that share an id are told apart by source and text; rows that share all three are one as good
    as another and are numbered.
    """
    keys = ("id", "size", "source", "text_hash")
    ids, sizes, sources, hashes, number = names = [free_name(docs, f"mix_{k}") for k in (*keys, "number")]
    copies = free_name(docs, "copies")
    plan = _hashed_mix(docs, id_col, text_col, source_col).select(
        F.col(id_col).alias(ids), F.col("size").alias(sizes), F.col("source").alias(sources),
        F.col("text_hash").alias(hashes), F.col("copies").alias(copies))
    plan = plan.withColumn(number, F.row_number().over(W.partitionBy(*names[:4]).orderBy(F.desc(copies))))
    own = [free_name(docs, f"own_{k}") for k in (*keys, "number")]
    rows = docs.withColumns(dict(zip(own, (
        F.col(id_col), _size_of(F.col(text_col)), F.col(source_col), F.xxhash64(text_col)))))
    rows = rows.withColumn(own[4], F.row_number().over(W.partitionBy(*own[:4]).orderBy(own[3])))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own[:3], names)]
    met = same[0] & same[1] & same[2] & (F.col(own[3]) == F.col(hashes)) & (F.col(own[4]) == F.col(number))
    return rows.join(plan.where(F.col(copies) > 0), met).drop(*own, *names)

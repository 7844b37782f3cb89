"""Split, forest, calibration and attribution."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.models import attribution as A
from alertloom.models.forest import AlertModel, ForestSettings, raw_scores
from alertloom.models.split import stratified_split
from alertloom.plans import training
from alertloom.plans.catalogue import FMAP, NAMES, POLICY
from alertloom.sources import fixtures

SMALL = ForestSettings(trees=8, depth=4, min_leaf=10, prototypes=10)


@pytest.fixture(scope="module")
def run(spark, sf):
    return training.train(fixtures.alerts(spark, sf), FMAP, SMALL)


@pytest.fixture(scope="module")
def scored(spark, sf, run):
    from alertloom.operators.canonical import canonicalize
    from alertloom.operators.features import project_features
    features = project_features(canonicalize(fixtures.alerts(spark, sf)), FMAP)
    return run.model.score(features)


def test_split_sizes_are_exact(spark):
    df = spark.range(1000).selectExpr("cast(id AS STRING) AS doc_id", "if(id < 101, 1, 0) AS label")
    rows = stratified_split(df).groupBy("label", "part").count().collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {
        (0, "train"): 629, (0, "val"): 135, (0, "test"): 135,
        (1, "train"): 70, (1, "val"): 15, (1, "test"): 16}
    first = {r["doc_id"]: r["part"] for r in stratified_split(df).collect()}
    assert first == {r["doc_id"]: r["part"] for r in stratified_split(df.repartition(5)).collect()}


def test_scores_separate_the_classes(run):
    precision, cut, report = run.evaluation()
    row = precision.first()
    assert row["average_precision"] > row["positives"] / row["n"]
    assert 0 <= cut.first()["cut"] <= 1
    assert report.count() == 5


def test_save_and_load(spark, run, scored, tmp_path):
    run.model.save(str(tmp_path / "model"))
    again = AlertModel.load(spark, str(tmp_path / "model"))
    rows = scored.select("doc_id", F.col("score").alias("old"), *NAMES)
    gap = again.score(rows).agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
    assert gap == 0.0 and again.names == NAMES


def test_tree_attribution_adds_up(run, scored):
    rows = run.attributed(scored)
    gap = rows.agg(F.max(F.expr(
        f"abs(aggregate(phi, 0D, (s, x) -> s + x) + {run.leaves.expected()!r}D - raw_score)")))
    assert gap.first()[0] < 1e-9


def test_background_attribution_adds_up(spark, run, scored):
    points, weights = run.background
    base = raw_scores(run.model.forest, spark.createDataFrame(
        [tuple(map(float, p)) for p in points], ", ".join(f"`{n}` DOUBLE" for n in NAMES)), NAMES)
    mean = float(np.average([r["raw_score"] for r in base.select("raw_score").collect()],
                            weights=weights))
    rows = A.attribute(scored, run.leaves, points, weights, only=F.col("raw_score") > 0.5)
    done = rows.where("phi IS NOT NULL")
    gap = done.agg(F.max(F.expr(
        f"abs(aggregate(phi, 0D, (s, x) -> s + x) + {mean!r}D - raw_score)")), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == scored.where("raw_score > 0.5").count()


def brute_shapley(leaves, x_bins, stand_in):
    """Every subset of the features in use; ``stand_in`` gives a leaf's factors when absent."""
    used = sorted(leaves.thresholds)

    def value(present):
        total = 0.0
        for tree in leaves.trees:
            for leaf in tree:
                product = leaf.value
                for (f, lo, hi), share in zip(leaf.conditions, leaf.shares):
                    product *= float(lo < x_bins[f] <= hi) if f in present else share
                total += product
        return total

    m, out = len(used), {}
    for f in used:
        others = [g for g in used if g != f]
        out[f] = sum(
            math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
            * (value({*s, f}) - value(set(s)))
            for k in range(m) for s in itertools.combinations(others, k))
    return out


def test_closed_form_equals_brute_force():
    rng = random.Random(2)
    thresholds = {f: [0.5, 1.5] for f in range(5)}
    trees = []
    for _ in range(3):
        trees.append([])
        for _ in range(4):
            fs = rng.sample(range(5), 3)
            trees[-1].append(A.Leaf(rng.random(), [
                (f, *sorted(rng.sample((-1, 0, 1, 2), 2))) for f in fs],
                [rng.random() for _ in fs]))
    leaves = A.Leaves(trees, thresholds, [f"f{n}" for n in range(5)])
    bins = np.array([[rng.randint(0, 2) for _ in range(5)] for _ in range(20)])
    phi = A.evaluate(A.leaf_tables(leaves), bins, 5)
    for row, got in zip(bins, phi):
        expected = brute_shapley(leaves, row, None)
        assert all(math.isclose(got[f], v, abs_tol=1e-12) for f, v in expected.items())


def test_long_paths_without_tables(monkeypatch):
    rng = random.Random(3)
    thresholds = {f: [0.5] for f in range(12)}
    trees = [[A.Leaf(rng.random(), [(f, *rng.choice([(-1, 0), (0, 1)])) for f in rng.sample(range(12), m)],
                     [rng.random() for _ in range(m)]) for m in (12, 11, 7, 1)] for _ in range(2)]
    leaves = A.Leaves(trees, thresholds, [f"f{n}" for n in range(12)])
    bins = np.array([[rng.randint(0, 1) for _ in range(12)] for _ in range(30)])
    tabulated = A.evaluate(A.leaf_tables(leaves), bins, 12)
    monkeypatch.setattr(A, "TABLE_BYTES", 0)
    plain = A.leaf_tables(leaves)
    assert not any("table" in t for t in plain)
    phi = A.evaluate(plain, bins, 12)
    assert np.allclose(phi, tabulated, atol=1e-12)
    expected = brute_shapley(leaves, bins[0], None)
    assert all(math.isclose(phi[0][f], v, abs_tol=1e-12) for f, v in expected.items())
    for row, got in zip(bins, phi):
        met = sum(leaf.value for t in trees for leaf in t if all(lo < row[f] <= hi for f, lo, hi in leaf.conditions))
        assert math.isclose(got.sum() + leaves.expected(), met, abs_tol=1e-12)


def test_background_without_tables_and_in_parts(spark, run, scored, monkeypatch):
    points, weights = run.background
    want = {r["doc_id"]: r["phi"] for r in A.attribute(scored, run.leaves, points, weights).collect()}
    monkeypatch.setattr(A, "TABLE_BYTES", 0)
    monkeypatch.setattr(A, "BROADCAST_BYTES", 3000)
    got = A.attribute(scored, run.leaves, points, weights)
    assert all(np.allclose(r["phi"], want[r["doc_id"]], atol=1e-9) for r in got.collect())


def test_deep_forest_adds_up(spark, sf):
    deep = training.train(fixtures.alerts(spark, sf), FMAP, ForestSettings(trees=6, depth=12, min_leaf=1, prototypes=10))
    assert max(len(leaf.conditions) for t in deep.leaves.trees for leaf in t) > 6
    features = deep.model.score(training_features(spark, sf))
    gap = deep.attributed(features).agg(F.max(F.expr(
        f"abs(aggregate(phi, 0D, (s, x) -> s + x) + {deep.leaves.expected()!r}D - raw_score)")))
    assert gap.first()[0] < 1e-9


def training_features(spark, sf):
    from alertloom.operators.canonical import canonicalize
    from alertloom.operators.features import project_features
    return project_features(canonicalize(fixtures.alerts(spark, sf)), FMAP)


def test_packed_keys_round_trip():
    leaves = A.Leaves([], {f: [float(k) for k in range(500)] for f in range(20)},
                      [f"f{n}" for n in range(20)])
    _, groups = A.packed_keys(leaves)
    assert len(groups) > 1
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 501, size=(50, 20))
    packed = np.zeros((50, len(groups)), dtype=np.int64)
    for c, group in enumerate(groups):
        for f, radix in group:
            packed[:, c] = packed[:, c] * radix + bins[:, f]
    assert (A.unpack(packed, groups, 20) == bins).all()


@pytest.mark.parametrize("method", ["tree", "background", "importances", "none"])
def test_explanations(spark, sf, run, method):
    docs = training.explain(fixtures.alerts(spark, sf), run, POLICY, FMAP, method)
    rows = docs.selectExpr("size(top_features) AS k", "reason", "top_features",
                           "exists(top_features, t -> t.value = 0) AS zero").collect()
    assert len(rows) == 1000 and max(r["k"] for r in rows) <= 12 and not any(r["zero"] for r in rows)
    if method == "none":
        assert {r["reason"] for r in rows} == {"Model score only"}
    else:
        for r in rows[:50]:
            impacts = [abs(t["impact"]) for t in r["top_features"]]
            assert impacts == sorted(impacts, reverse=True)
            assert r["reason"].startswith("Top impact: ")


def test_the_training_table_is_dealt_to_all_cores(spark):
    rows = spark.range(0, 40_000, 1, 1).withColumn("part", F.lit("train"))
    parts = training.dealt(rows, 40_000)
    sizes = [r["n"] for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == min(4, spark.sparkContext.defaultParallelism) and max(sizes) <= 10_100
    assert parts.exceptAll(rows).isEmpty() and rows.exceptAll(parts).isEmpty()
    assert training.dealt(rows, 10_000) is rows  # small tables stay as they are


def test_calibration_scores_every_row_once(spark):
    from alertloom.models.forest import fit_sigmoid
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            read.add(batch.num_rows)
            yield batch

    scored = spark.range(0, 400, 1, 4).selectExpr("(id % 40) / 40D AS raw_score", "cast(id % 40 >= 10 + id % 20 AS INT) AS label")
    slope, _ = fit_sigmoid(scored.mapInArrow(count, scored.schema))
    assert slope > 0
    assert read.value == 400

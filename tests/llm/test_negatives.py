"""Hard negatives against brute force, and the edge cases."""

import math
import random

import numpy as np

from alertloom.llm import negatives, queries

ROWS = "vec_id long, embedding array<float>, label int"


def usable(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        entry = (label, [math.floor(256 * x) for x in np.float32(v).astype(float)])
        kept[i] = min(kept.get(i, entry), entry)
    return kept


def brute(rows, every=100):
    kept, out = usable(rows), set()
    for a in kept:
        if a % every:
            continue
        label, v = kept[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a)
        for p, i, other in [s for s in scored if s[2] == label][:5]:
            windows = [(n, j) for n, j, tag in scored if tag != label and 80 * -p <= 100 * -n <= 100 * -p]
            out |= {(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(windows[:5], 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(n, seed, dims=8, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def test_equals_brute_force(table):
    for seed, every in ((1, 100), (2, 7)):
        rows = vectors(700, seed)
        assert found(negatives.mine(table(rows, ROWS), every)) == brute(rows, every) != set()


def test_blocks_chunks_and_the_join_without_broadcast(table, monkeypatch):
    rows = vectors(500, 3)
    for name, value in (("ROW_BLOCK", 37), ("ANCHOR_BLOCK", 4), ("MAX_BROADCAST_BYTES", 0)):
        monkeypatch.setattr(negatives, name, value)
    assert found(negatives.mine(table(rows, ROWS), 10)) == brute(rows, 10)


def test_copies_ties_nulls_uneven_vectors_and_clashing_columns(table):
    rng = random.Random(4)
    same = [0.5, 0.25, -1.0]
    rows = [(i, same, i % 3) for i in range(0, 400)]
    rows += [(i, [rng.random() for _ in range(rng.randint(0, 5))], rng.randrange(3)) for i in range(400, 500)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (601, [math.inf], 2), (602, [math.nan, 1.0], 2), (603, same, None),
             (None, same, 1), (100, same, 1), (100, same, 1), (200, [0.1], 0)]
    wide = [(*r, 1, "x", True) for r in rows]
    got = found(negatives.mine(table(wide, ROWS + ", id int, anchor string, kind boolean")))
    assert got == brute(rows) != set()


def test_empty_table_and_anchors_without_partners(table):
    assert found(negatives.mine(table([], ROWS))) == set()
    assert found(negatives.mine(table([(0, [1.0], 1), (1, [1.0], 2)], ROWS))) == set()


def test_products_stay_exact_for_any_size():
    rng = np.random.default_rng(5)
    for top in (1 << 8, 1 << 27, 1 << 40):
        a, b = rng.integers(-top, top, (5, 9)), rng.integers(-top, top, (7, 9))
        want = a.astype(object) @ b.astype(object).T
        assert (negatives.inner_products(a, b) == np.clip(want, -(1 << 63), (1 << 63) - 1).astype(np.int64)).all()


def test_packed_keys_sort_by_anchor_score_kind_and_id():
    rng = random.Random(6)
    rows = [(rng.choice([-5, 0, 7]), rng.choice([-(1 << 63), -2, 0, 3, (1 << 63) - 1]), rng.random() < 0.5,
             rng.choice([-9, 0, 4])) for _ in range(300)]
    keys = sorted(negatives.packed_key(*r) for r in rows)
    assert [negatives.unpacked(k) for k in keys] == sorted(rows, key=lambda r: (r[0], -r[1], not r[2], r[3]))


def test_query_over_the_given_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert found(queries.op12_negatives(spark, sf)) == brute(moved)

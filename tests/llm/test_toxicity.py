"""Toxicity: the automata against edit distances, the model on held-out rows, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import queries, toxicity
from alertloom.llm.automaton import Lexicon, edits

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"
TERMS = ["blockhead", "dimwitted", "nitwit", "vermin"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_find_what_edit_distances_find():
    rng = random.Random(1)
    make = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randint(lo, hi)))
    words, stems = {make(1, 11): 1.0 for _ in range(200)}, {make(4, 9): 1.0 for _ in range(20)}
    lexicon = Lexicon(words, stems)
    for _ in range(1000):
        token = make(0, 12)
        want = {(w, d) for w in words if (d := distance(w, token)) <= min(edits(w, False), edits(token, False))}
        want |= {(w, d) for w in stems if (d := min(distance(w, token[:k]) for k in range(len(token) + 1)))
                 <= min(edits(w, True), edits(token, False))}
        assert {(e, d) for e, _, d in lexicon.near(token)} == want
        assert lexicon.possible(token) or not want


def prose(rng, n=40):
    parts = "the of and ing er th on ent ra li mo su ka".split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def misspelt(rng, word):
    i = rng.randrange(1, len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + "*" + word[i + 1:], word[:i] + "x" + word[i:]])


def corpus(n=900, seed=2):
    rng, docs, labels = random.Random(seed), [], []
    for k in range(n):
        words, toxic = prose(rng), int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice([*TERMS, "grim" + rng.choice(words)]))
        docs.append((k, " ".join(words)))
        if rng.random() < 0.9:
            labels.append((k, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))


def test_held_out_accuracy(spark, model):
    docs, labels = corpus(300, 3)
    scored = spark.createDataFrame(docs, DOCS)
    got = {r[0]: r[1] >= 0.7 for r in scored.select("doc_id", toxicity.score(scored, model, F.col("text"))).collect()}
    hits = [(got[k], bool(t)) for k, t in labels]
    assert sum(a and b for a, b in hits) >= 0.95 * sum(b for _, b in hits)
    assert sum(a and not b for a, b in hits) <= 0.02 * sum(not b for _, b in hits)
    assert set(TERMS) <= set(model.words) and any(s.startswith("grim") for s in model.stems)


def test_misspelt_terms_are_caught_and_quotations_are_not(model):
    rng = random.Random(4)
    for term in ("blockhead", "dimwitted"):
        for _ in range(20):
            assert model.score(" ".join([*prose(rng), f"you {misspelt(rng, term)} and {misspelt(rng, term)}"])) >= 0.7
        plain = " ".join(prose(rng))
        assert model.score(f"{plain} you {term} {plain}") >= 0.7
        assert model.score(f'{plain} she said "{term}" and wrote the word down {plain}') < 0.7
        assert model.score(plain) < 0.1


def test_known_clean_neighbours_are_no_misspellings(spark):
    docs, labels = corpus(400, 5)
    docs = [(k, t + " blockheads") for k, t in docs]
    got = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert "blockheads" in got.clean and not got.match("blockheads") and got.match("blockheadz")


def test_copies_of_one_toxic_text_teach_once(spark):
    docs, labels = corpus(300, 6)
    text = "peculiar wording " + " ".join(prose(random.Random(7)))
    docs += [(1000 + k, text) for k in range(200)]
    labels += [(1000 + k, 1) for k in range(200)]
    got = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert "peculiar" not in got.words and "wording" not in got.words


def test_nulls_empty_and_long_texts_repeats_clashes_and_empty_tables(spark, table, model):
    long = "the of and " * 200_000 + "blockhead nitwit vermin"
    rows = [(1, None), (2, ""), (None, "nitwit vermin"), (4, "!!! ***"), (5, long), (6, "nitwit vermin"), (6, "nitwit vermin")]
    docs = table([(*r, 1, "x") for r in rows], DOCS + ", toxic int, h string")
    got = docs.select("doc_id", toxicity.score(docs, model, F.col("text")).alias("s")).collect()
    by = {r["doc_id"]: r["s"] for r in got}
    assert len(got) == 7 and all(0 <= r["s"] <= 1 for r in got)
    assert by[1] == by[2] == by[4] < 0.1 and by[5] >= 0.7 and by[6] == by[None] >= 0.7
    none = toxicity.fit(table([], DOCS), table([], LABELS))
    assert none.words == {} and none.score("nitwit") < 0.1
    odd = table([(None, 1), (6, None), (6, 1), (6, 0), (6, 1)], LABELS)
    assert toxicity.labelled(docs, odd).select("toxic").collect() == [(True,)]


def test_large_label_tables_are_joined_by_shuffle(spark, monkeypatch):
    docs, labels = (spark.createDataFrame(r, s) for r, s in zip(corpus(200, 8), (DOCS, LABELS)))
    want = sorted(map(tuple, toxicity.labelled(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "MAX_BROADCAST_LABELS", 3)
    assert sorted(map(tuple, toxicity.labelled(docs, labels).collect())) == want


def test_query_covers_all_documents(spark, sf):
    got = queries.op13_toxicity(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert np.mean([r["held_out"] for r in got]) == pytest.approx(1 / 3, abs=0.1)

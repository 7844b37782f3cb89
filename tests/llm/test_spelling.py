"""Spelling variants against brute force, and its edge cases."""

import random
import re
import zlib
from collections import Counter

from alertloom.llm import queries, spelling

DOCS = "doc_id long, text string"


def brute(rows):
    """{word: (form, root, n, n_near, form_n)} by comparing all words with all words."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    out, forms = {}, {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = others[0] if others and words[others[0]] >= 10 * n else None
        forms[w] = form
        out[w] = [form, None, n, len(others), words[form] if form else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus(seed, docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(6, 10))) for _ in range(25)]
    rows = []
    for doc in range(docs):
        words = []
        for _ in range(60):
            w = stems[min(24, int(rng.expovariate(0.25)))]
            if rng.random() < 0.25:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1:]])
            words.append(w.title() if rng.random() < 0.3 else w)
        rows.append((doc, rng.choice([" ", "-", "1"]).join(words)))
    return rows


def test_equals_brute_force(table):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(spelling.variants(table(rows, DOCS))) == brute(rows)


def test_chain_of_forms_ties_and_very_long_runs(table):
    long = "ab" * 30_000
    rows = [(1, " ".join(["abcdefgh"] * 2 + ["abcdefghi"] * 20 + ["abcdefghij"] * 400 + ["zbcdefgh"] * 20)),
            (2, f"{long} {long} {long}x {long}x"), (3, "ÀÉÎabcd Àéîabcd àéîabcd÷× " * 3)]
    assert found(spelling.variants(table(rows, DOCS))) == brute(rows)


def test_nulls_empty_texts_repeats_and_clashing_columns(table):
    rows = [(None, "mellowing mellowing"), (4, None), (5, ""), (6, "mellowinng meLLowing"), (6, "mellowinng meLLowing"), (7, "short 123")]
    more = [(*r, "x", 1, "y", 2) for r in rows]
    got = found(spelling.variants(table(more, DOCS + ", word string, n int, near string, root int")))
    assert got == brute(rows) and got
    assert found(spelling.variants(table([], DOCS))) == {}


def test_signatures_are_shared_by_all_words_one_edit_apart():
    rng = random.Random(3)
    for _ in range(2000):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(7, 14)))
        i = rng.randrange(len(w))
        swapped, shorter = w[:i] + "z" + w[i + 1:], w[:i] + w[i + 1:]
        for a, b, short, kind in ((w, swapped, len(w), "replaced"), (w, shorter, len(w) - 1, "inserted")):
            assert set(spelling.signatures(a, short, kind)) & set(spelling.signatures(b, short, kind))


def test_query_over_the_given_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = found(queries.op11_spelling(spark, sf))
    assert got == brute([tuple(r) for r in rows])

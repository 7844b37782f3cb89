"""Quality rules, licences, mixing and decontamination against small brute-force versions."""

import random
import re
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from alertloom.llm import decontaminate, licenses, mixing, quality
from alertloom.llm.license_texts import KNOWN

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
                    for _ in range(n))


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(inside))


def test_quality_counts_and_verdicts(table):
    rng = random.Random(2)
    eight = "one two three four five six seven eight"
    noise = "".join(chr(rng.randrange(33, 126)) for _ in range(3000))
    rows = [prose(rng, 200), None, "", "short text", "so so " * 300, f"{eight} x {eight} y" + prose(rng, 60),
            "same line\nsame line\n \n\nünïcode wörds # * $\nsame line " + prose(rng, 30), noise,
            " ".join(noise[i:i + 9] for i in range(0, 3000, 9)), prose(rng, 9000), "a\x0bb\x1cc\x85d\xa0e"]
    docs = table(list(enumerate(rows)), "rules int, text string")
    got = {r["rules"]: r for r in docs.select("rules", quality.rules(F.col("text")).alias("q"))
           .select("rules", "q.*").collect()}
    for k, text in enumerate(rows):
        row = got[k]
        counts = plain_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines,
                row.n_repeat_words) == counts, text
        assert row.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        if text:
            packed = len(zstandard.compress(text.encode(), 3)) / len(text.encode())
            assert abs(row.ratio - packed) < 0.01
    assert [k for k in got if got[k].kept] == sorted([0, 5, 6, 9], key=list(got).index)
    kept = quality.keep_good(docs)
    assert kept.columns == ["rules", "text"] and {r.rules for r in kept.collect()} == {0, 5, 6, 9}


def test_licences_survive_case_punctuation_copyright_and_spelling(table):
    mit = KNOWN["MIT"]
    changed = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-licence")
    rows = [(1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, " ... "),
            (6, "Some prose.\nReleased  under the MIT licence\nMore."), (6, "Some prose.")]
    got = licenses.scan(table(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.license_id, r.notices) for r in got if r.license_id or r.notices)
    assert found == sorted([(1, "MIT", ""), (2, "MIT", ""), (6, None, "MIT notice")], key=lambda r: r[0])
    assert len(got) == 7 and all(r.text_digest is None for r in got if r.doc_id in (4, 5))


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_its_targets(table):
    rng = random.Random(3)
    rows = []
    for k in range(1500):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "", "é"])
        rows.append((k, prose(rng, rng.choice([1, 5, 30, 100, 300])), source))
    rows += [(2000, None, "a"), (2001, "", "z"), (2002, "one word", "tiny")] + [(7, "same row twice", "b")] * 2
    docs = table(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    first = [tuple(r) for r in mixing.mix(docs).collect()]
    assert Counter(first) == Counter(tuple(r) for r in mixing.mix(docs.repartition(5)).collect())
    sizes, taken = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    goals = plain_targets(dict(sizes))
    for doc, size, source, source_size, target, copies, took in first:
        assert source_size == sizes[source] and abs(target - goals[source]) < 1e-6 * max(1, target)
        assert took == copies * size <= 3 * size
        taken[source] += took
    assert len(first) == len(rows)
    for source, goal in goals.items():
        assert abs(taken[source] - goal) <= max(3, 0.01 * goal), (source, taken[source], goal)
    mixed = mixing.mixed(docs)
    assert mixed.columns == ["doc_id", "text", "source", "size", "copies"]
    assert sum(r.copies * len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mix_of_nothing(table):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(table([], schema, 1)).collect() == []
    assert [r.taken for r in mixing.mix(table([(1, None, None)], schema)).collect()] == [0]


def plain_contamination(docs, items, k=13):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda text: split.findall((text or "").translate(lower))
    out = []
    for doc, text in docs:
        words, hit, found = cut(text), set(), set()
        for item, body in items:
            w = cut(body)
            for i in range(max(1, len(w) - k + 1) if w else 0):
                window = w[i:i + k]
                for at in range(len(words) - len(window) + 1):
                    if words[at:at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(str(item))
        out.append((doc, len(words), len(hit), sorted(found),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out)


def test_contamination_equals_brute_force(table, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "a"] + [f"word{k}" for k in range(40)]
    take = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(take(n))) for k, n in enumerate([30, 14, 13, 40, 25])]
    items += [(5, "short item"), (6, "the"), (7, None), (8, "?!"), (9, items[0][1]), (10, "Two Of")]
    docs = []
    for k in range(60):
        words = take(rng.choice([0, 1, 10, 60, 400]))
        if k % 3 == 0:
            source = items[rng.randrange(5)][1].split()
            a = rng.randrange(max(1, len(source) - 12))
            at = rng.randrange(len(words) + 1)
            words[at:at] = source[a:a + rng.choice([12, 13, 20])] * rng.choice([1, 2])
        docs.append((k, "; ".join(words).title()))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, items[1][1] + "é")]
    for bound in (decontaminate.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", bound)
        got = decontaminate.contamination(
            table(docs, "doc_id long, text string").withColumn("pos", F.lit(1)),
            table(items, "item_id long, text string"))
        rows = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated)
                      for r in got.collect())
        assert rows == plain_contamination(docs, items)


def test_contamination_of_nothing(table):
    docs = table([(1, "some words"), (None, None)], "doc_id long, text string")
    none = table([], "item_id long, text string", 1)
    got = decontaminate.contamination(docs, none).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in got) == [(0, 0, False), (2, 0, False)]
    assert decontaminate.contamination(none.withColumnRenamed("item_id", "doc_id"), none).collect() == []
    assert decontaminate.clean_rows(docs, none).count() == 2


def test_entire_licences_with_other_holders_are_found(table):
    names = ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0", "Artistic", "GFDL-1.3"]
    holders = ["Copyright Some One 2020", "(c) Some One, 2020", "Copyright (C) 1999-2021 The Authors", "© Some One",
               "# Copyright 2020 by Some One. All rights reserved."]
    rows = [(k, f"{holders[k % 5]}\n\n" + re.sub(r"\bLICENSE\b", "LICENCE", KNOWN[n].upper()).replace(",", " ,"))
            for k, n in enumerate(names)]
    rows += [(100, KNOWN["GPL-3"][:-300]), (101, "licence licence"), (102, "license license"), (103, None)]
    got = {r.doc_id: r for r in licenses.scan(table(rows, "doc_id long, text string")).collect()}
    assert [got[k].license_id for k in range(len(names))] == names
    assert got[100].license_id is None and got[103].text_digest is None
    assert got[101].text_digest == got[102].text_digest


def test_lines_without_a_keyword_are_never_notices(table):
    assert licenses.keywords(["released under the mit license", "license"]) == []
    words = licenses.keywords(["released under the mit license", "spdx license identifier mit"])
    assert words == ["identifier", "released"]
    own = {"plain": "license", "odd": "Licensed under our terms"}
    got = licenses.scan(table([(1, "x\nLicence.\ny"), (2, "licenced under our TERMS")], "doc_id long, text string"), known=own)
    assert sorted((r.doc_id, r.license_id, r.notices) for r in got.collect()) == [(1, None, "plain"), (2, "odd", "odd")]

"""Language ID, language model and chat masks."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertloom.llm import chat, gru, langid, lm
from alertloom.llm.common import hashed_part

ALPHABETS = {"en": "the of and ing er th on", "de": "der sch ein ung ich tz au",
             "fr": "que eau oi é è les ai", "es": "os ción ñ ar la el ll"}


def sentences(lang, n, rng):
    parts = ALPHABETS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_edge_cases(table):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        lang = rng.choice(list(ALPHABETS))
        rows.append((k, sentences(lang, rng.randint(5, 60), rng), lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? ½", None), (1003, "the", None),
             (1003, "the", None)]
    docs = table(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = hashed_part(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held), max_per_lang=60)
    out = docs.select("doc_id", "lang", held.alias("held"),
                      langid.predict(docs, model, F.col("text")).alias("p")).collect()
    assert len(out) == len(rows)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    scored = [r for r in out if r.held and r.doc_id < 1000]
    assert sum(r.p.lang_pred == r.lang for r in scored) >= 0.97 * len(scored)
    assert {r.p.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r.p.score <= 1 for r in out)


def test_language_without_or_with_one_known_language(table):
    docs = table([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    found = docs.select(langid.predict(docs, langid.fit(docs), F.col("text")).alias("p")).collect()
    assert {r.p.lang_pred for r in found} == {"und"}
    known = table([(1, "some text", "xx")], "doc_id long, text string, lang string")
    found = docs.select(langid.predict(docs, langid.fit(known), F.col("text")).alias("p")).collect()
    assert {r.p.lang_pred for r in found} == {"xx", "und"}
    assert langid.family("pt-BR") == "romance" and langid.family("tlh") == "tlh"


def test_gradients_equal_differences():
    p = {k: v.astype(np.float64) for k, v in gru.initial(np.arange(gru.SYMBOLS)[::-1]).items()}
    rng = np.random.default_rng(0)
    for k in ("Wc", "Wo"):
        p[k] = rng.normal(0, 0.3, p[k].shape)
    docs = [np.array([5, 9, 70, 1]), np.array([300, 1]), np.array([8, 8, 8, 2, 1])]
    got = {}
    trainer = gru.Trainer(p)
    trainer._step = lambda g, n: got.update({k: v.copy() for k, v in g.items()})
    x, y, _, keep, sizes = gru.grid(docs, 1, 2)
    real = np.arange(len(x))[:, None] < sizes[None, :]
    h = np.zeros((2, gru.HIDDEN))
    trainer._window(x, y, keep, real, h)

    def loss():
        states, _ = gru.run(p, x, keep, h)
        return -gru.log_chances(p, states[real], y[real]).sum()
    for k, at in (("U", (3, 5)), ("Un", (2, 2)), ("Wx", (1, 30)), ("b", (50,)), ("E", (5, 2)),
                  ("Wc", (1, 0)), ("bc", (1,)), ("Wo", (0, 8, 3)), ("bo", (0, 9))):
        kept, eps = p[k][at], 1e-3
        p[k][at] = kept + eps
        up = loss()
        p[k][at] = kept - eps
        down = loss()
        p[k][at] = kept
        assert got[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=2e-3), k


def test_lanes_score_as_single_documents():
    p = gru.initial(np.ones(gru.SYMBOLS))
    rng = np.random.default_rng(1)
    p["Wo"], p["Wc"] = (rng.normal(0, 1, p[k].shape).astype(np.float32) for k in ("Wo", "Wc"))
    docs = [np.append(rng.integers(0, gru.SYMBOLS, n), 1).astype(np.int32)
            for n in (0, 3, 90, 31, 32, 33, 500)]
    together = gru.score(p, docs, 1)
    alone = [gru.score(p, [d], 1)[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)
    total = np.exp(gru.log_chances(p, np.full((gru.SYMBOLS, gru.HIDDEN), 0.1, np.float32),
                                   np.arange(gru.SYMBOLS))).sum()
    assert total == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_language_model_scores(table, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(7)
    rows = [(k, sentences(rng.choice(list(ALPHABETS)), rng.randint(1, 60), rng)) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "Never seen WORDS \xa0here"), (403, "the of " * 3000),
             (403, "the of " * 3000)]
    docs = table(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    out = lm.score(docs, hashed_part(F.col("doc_id"), 5) == 1).collect()
    assert len(out) == len(rows)
    tokens = lambda text: [*(text or "").encode().lower().split(), None]
    counts = Counter(t for k, text in rows if zlib.crc32(str(k).encode()) % 5 != 1 for t in tokens(text))
    n, v = counts.total(), len(counts)
    texts = dict(rows)
    for row in out:
        own = tokens(texts[row.doc_id])
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert row.n_tokens == len(own) and row.train_tokens == n
        assert row.n_known == sum(counts[t] > 0 for t in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert -1e9 < row.score < 0
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in held) > 1.2 * sum(r.base_score for r in held)


def test_language_model_does_not_depend_on_partitions(spark, table, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 2)  # several levels of sums
    rng = random.Random(8)
    rows = [(k, sentences(rng.choice(list(ALPHABETS)), rng.randint(1, 60), rng)) for k in range(200)]
    held = hashed_part(F.col("doc_id"), 5) == 1
    scores = []
    for parts in (1, 7):
        out = lm.score(table(rows, "doc_id long, text string", parts), held, replica_tokens=400)
        scores.append({r.doc_id: r.score for r in out.collect()})
    assert all(scores[0][k] == pytest.approx(scores[1][k], rel=1e-5) for k in scores[0])


def test_language_model_learns_from_every_training_document(table, monkeypatch):
    seen = Counter()
    learn = gru.Trainer.learn
    rows = [(k, f"w{k} the of the") for k in range(90)]
    docs = table(rows, "doc_id long, text string")
    held = hashed_part(F.col("doc_id"), 5) == 1
    counts = lm.corpus_of(lm.token_counts(docs.where(~held), "text"))
    monkeypatch.setattr(gru.Trainer, "learn", lambda self, docs, end: seen.update(int(d[0]) for d in docs) or learn(self, docs, end))

    class Known:
        value = counts
    coded = list(lm._coded(Known)([docs.where(~held).selectExpr("xxhash64(doc_id) AS h", "cast(text AS BINARY) AS t")
                                   .toArrow().combine_chunks().to_batches()[0]]))
    vector = gru.flat(lm.first_params(counts))

    class Shared:
        value = vector
    rows_of = [type("B", (), {"columns": [c.column(0), c.column(0), c.column(1)]}) for c in coded]
    list(lm._replica(Shared)(rows_of))
    assert sum(seen.values()) == docs.where(~held).count()


def test_language_model_beats_word_frequencies_on_held_out_documents(spark, sf):
    from alertloom.llm import queries
    got = [r for r in queries.op4_language_model(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 1.0


def test_training_windows_reuse_their_arrays():
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(0, gru.SYMBOLS, 400), 1).astype(np.int32) for _ in range(64)]
    trainer = gru.Trainer(gru.initial(np.ones(gru.SYMBOLS)))
    trainer.learn(docs, 1)
    x, y, _, keep, _ = gru.grid(docs, 1, gru.TRAIN_LANES)
    h, part = np.zeros((64, gru.HIDDEN), dtype=np.float32), slice(0, gru.WINDOW)
    real = np.ones(x[part].shape, dtype=bool)
    tracemalloc.start()
    trainer._window(x[part], y[part], keep[part], real, h)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.2e6


def test_a_step_is_adams():
    rng = np.random.default_rng(3)
    trainer = gru.Trainer(gru.initial(np.ones(gru.SYMBOLS)))
    at, m, v = gru.flat(trainer.p).astype(np.float64), 0.0, 0.0
    for step in range(1, 5):
        slope = rng.normal(0, 3, len(at))
        trainer.slope[:] = slope
        trainer._step(trainer.g, 100)
        slope = slope / 100 * min(1, gru.CLIP / (np.sqrt((slope ** 2).sum()) / 100))
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        at -= gru.RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) * m / (np.sqrt(v) + 1e-8)
    assert np.allclose(gru.flat(trainer.p), at, atol=1e-5)


def test_texts_as_places_and_other_words():
    texts = [None, "", " \t", "A b\x0bc\u00a0d a\nzz A", "zz zz É q ", "b"]
    known = lm.Corpus({b"a": 0, b"b": 1}, np.array([3, 2]), 6, 20, 9, 15, 6)
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array(texts, pa.string()), pa.array(range(6))], ["h", "text", "id"])
    (out,) = lm._coded(type("Known", (), {"value": known}))([batch])
    assert [np.frombuffer(p, np.int16).tolist() for p in out.column(1).to_pylist()] == [
        [], [], [], [0, 1, -1, 0, -1, 0], [-1] * 4, [1]]
    assert [{p["word"]: p["n"] for p in r} for r in out.column(2).to_pylist()] == [
        {}, {}, {}, {"c\u00a0d": 1, "zz": 1}, {"zz": 2, "É": 1, "q": 1}, {}]
    assert out.column(3).to_pylist() == list(range(6))


def test_texts_are_taken_apart_once_for_training_and_scores(spark, table, tmp_path):
    rows = [(k, f"w{k} the of the") for k in range(30)]
    calls = spark.sparkContext.accumulator(0)
    coded = lm._coded

    def counted(known):
        def run(batches):
            def told():
                for batch in batches:
                    calls.add(batch.num_rows)
                    yield batch
            return coded(known)(told())
        return run
    lm._coded = counted
    try:
        assert lm.score(table(rows, "doc_id long, text string"), hashed_part(F.col("doc_id"), 5) == 1).count() == 30
    finally:
        lm._coded = coded
    assert calls.value == 30


def test_language_model_of_nothing(table):
    schema = "doc_id long, text string"
    assert lm.score(table([], schema, 1), F.lit(False)).collect() == []
    row = lm.score(table([(1, "a b")], schema), F.lit(True)).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0.0)


NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]", "<<s>", "a\\</s>\\", "", None, " lead", "trail ",
         "émoji 😀 ünï", "\n\n", "[INST", "<s", "<s>[/INST]</s>", "\\\\<s>", "<|endoftext|>"]


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(8)
    for text in [t for t in NASTY if t] + ["".join(rng.choice("\\</s>[INT]") for _ in range(12))
                                           for _ in range(3000)]:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)


@pytest.mark.parametrize("limits", [None, (20, 60)])
def test_chat_round_trip(table, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(chat, "SEGMENT_CHARS", limits[0])
        monkeypatch.setattr(chat, "BUFFER_CHARS", limits[1])
    rng = random.Random(9)
    rows = []
    for conv in [*range(25), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "</s>"])
            rows.append((conv, turn if turn != 3 else None, role, rng.choice(NASTY) or None))
    turns = table(rows, "conv_id long, turn long, role string, text string").withColumn(
        "formatted", F.lit("clash"))
    out = chat.format_conversations(turns).mapInArrow(chat.read_back, chat.DIGESTS).collect()
    assert len(out) == 26
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for row in out:
        own = sorted((r for r in rows if r[0] == row.conv_id), key=key)
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert row.loss_chars == len(loss)
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_mask_tokens_cover_assistant_text_only(table):
    turns = table([(1, 0, "user", "hello there"), (1, 1, "assistant", " well, hello!"),
                   (1, 2, "user", "bye")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).collect()[0]
    spans = [(a, b) for a, b, m in zip(row.token_starts, row.token_ends, row.loss_mask) if m]
    assert "".join(row.formatted[a:b] for a, b in spans) == " well, hello!"
    assert len(row.token_ids) == len(row.loss_mask) and re.match(r"<s>\[INST\]user", row.formatted)


def test_chat_of_nothing(table):
    none = table([], "conv_id long, turn long, role string, text string", 1)
    assert chat.format_conversations(none).collect() == []

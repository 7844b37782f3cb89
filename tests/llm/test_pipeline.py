"""The pipeline keeps clean documents and acts on planted ones."""

import random

import corpus_pipeline


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
                    for _ in range(n))


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "secret_scans", "mixing"]


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(10)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage = prose(rng, 40)
    clean = {k: prose(rng, 150) for k in range(60)}
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in clean.items()]
    words = clean[5].split()
    words[70] = "changed"
    rows += [(100, "too few words", "en", "s0", 13), (101, "so " * 200, "en", "s1", 600),
             (102, clean[4], "en", "s2", 1), (103, " ".join(words), "en", None, 2),
             (104, prose(rng, 60) + " " + passage, "en", "s1", 3), (105, None, None, None, None),
             (106, prose(rng, 60) + " password=abcdef0123456789 " + prose(rng, 60), "en", "s0", 4)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [set(docs.toPandas().doc_id)]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] + (
            ["copies"] if name == "mixing" else [])
        kept.append({r.doc_id for r in docs.collect()})
        if name == "secret_scans":
            text = docs.where("doc_id = 106").first().text
            assert "abcdef0123456789" not in text and "[SECRET]" in text
    assert kept[0] - kept[1] == {100, 101, 105}
    assert kept[1] - kept[2] == {102, 103}
    assert kept[2] - kept[3] == {104} and kept[3] == kept[4]
    assert kept[5] <= kept[4] and set(clean) | {106} == kept[4]


CLASHING = ("component_id component_node node text_hash text_hash2 bad_id bad_hash mix_id mix_rank mix_no mix_size "
            "own_id own_number size copies kept ratio r s h id start n_words item_id source_size part").split()


def test_stages_take_columns_of_any_name(spark, tmp_path):
    rng = random.Random(11)
    texts = [prose(rng, 150) for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), *range(len(CLASHING))) for k, t in enumerate([*texts, *texts[:5], None, ""])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` int" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        more = ["copies_"] if name == "mixing" else []
        assert out.columns == docs.columns + more, name
        got = out.collect()
        assert got and all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in got), name


def test_stages_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == []


def test_mixing_gives_rows_that_share_an_id_their_own_copies(spark):
    from alertloom.llm import mixing
    docs = spark.createDataFrame(
        [(None, f"{w} b c", s) for s in ("x", "y") for w in "klmnopq"] + [(1, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "y")],
        "doc_id long, text string, source string")
    plan = mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).collect()
    got = mixing.mixed(docs).selectExpr("source", "3 * copies AS taken").groupBy("source").agg({"taken": "sum"}).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, got))
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mixed(docs).collect()))

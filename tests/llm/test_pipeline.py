import random

import corpus_pipeline

WORDS = {"en": "the of and to in is that for on with this", "de": "der die und das nicht ist mit von auf ein", "fr": "le la les des une est dans pour que avec"}


def documents(rng):
    rows = []
    for i in range(90):
        lang = "en de fr".split()[i % 3]
        words = [rng.choice(WORDS[lang].split()) + rng.choice(["", "", "er", "en", "ly", "tion"]) for _ in range(60)]
        rows.append((i, "\n".join(" ".join(words[k : k + 15]) for k in range(0, 60, 15)), lang))
    item = " ".join(f"question{k}" for k in range(30))
    rows += [
        (100, None, None), (101, "", "en"), (102, "1234 -- 5678", None), (103, rows[0][1], "en"), (104, rows[1][1] + "\nnoch eine zeile und das ist nicht von mir", "de"),
        (105, "and this is the text of the question that was found\n" + item + "\nand that is the end of it", "en"), (106, rows[2][1], "fr"), (106, rows[2][1], "fr"), (None, rows[5][1], "fr"),
        (1 << 60, "this text is for the end of the table and it is in this row " * 400, "en"), ((1 << 60) + 1, "is that the last of them", "en"),
    ]
    return rows, item


CLASH = ["_score", "_lang_pred", "_hits", "_dropped", "_of", "gone", "row", "n_lines", "uid", "part"]


def tables(spark, folder, rows, item):
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *[f"'x' as {c}" for c in CLASH]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_and_their_decisions(spark, tmp_path):
    rows, item = documents(random.Random(4))
    tables(spark, tmp_path, rows, item)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{k}")
        left = spark.read.parquet(f"{tmp_path}/stage-{k}")
        if k < 4:
            assert left.columns == docs.columns, name
        docs, seen[name] = left, [r.doc_id for r in left.collect()]
    rejected = {100, 101, 102}
    assert not rejected & set(seen["language ID"]) and set(range(90)) | {103, 105, None, 1 << 60, (1 << 60) + 1} <= set(seen["language ID"])
    assert 103 not in seen["line dedup"]  # every line of it stands in document 0
    assert set(range(90)) <= set(seen["near-dedup"]) and 105 in seen["near-dedup"] and len(seen["near-dedup"]) == len(set(seen["near-dedup"]))
    assert 105 not in seen["decontamination"] and set(range(90)) <= set(seen["decontamination"])
    assert set(seen["packing"]) == set(seen["decontamination"]) and (1 << 60) + 1 in seen["packing"]
    whole = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect()}
    assert whole == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}


def test_empty_table(spark, tmp_path):
    tables(spark, tmp_path, [], "a question")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

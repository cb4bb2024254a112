"""Each stage of the corpus pipeline on planted cases."""

import random

import pytest

import corpus_pipeline

R = random.Random(11)


def prose(n):
    return " ".join("".join(R.choice(["an", "er", "th", "on", "ing", "le", "ti", "ou"]) for _ in range(R.randint(1, 4))) for _ in range(n))


def test_stages(spark, tmp_path):
    clean = [prose(150) for _ in range(80)]
    junk = [" | ".join(prose(60).split()) + " !!" for _ in range(80)]
    item, passage = prose(30), prose(70)
    texts = dict(enumerate(clean)) | {100 + i: t for i, t in enumerate(junk)}
    texts |= {200: clean[0], 201: clean[1] + " more", 202: prose(40) + " " + item + " " + prose(40), 203: prose(60) + " " + passage + " " + prose(60), 204: prose(60) + " " + passage + " " + prose(60)}
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(0, 60), *range(100, 160)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append({r.doc_id for r in docs.collect()})
        if name == "repeated_passages":
            text = {r.doc_id: r for r in docs.collect()}
            assert all(passage[20:-20] not in text[i].text and text[i].n_chars == len(text[i].text) < len(texts[i]) - 200 for i in (203, 204))
            assert text[5].text == texts[5]
    assert seen[0] == set(range(80)) | {200, 201, 202, 203, 204}
    assert seen[1] == seen[0] - {200, 201} and seen[2] == seen[1] and seen[3] == seen[2] - {202} and seen[4] == seen[3]


def test_run_on_an_empty_table(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_all_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10 and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    with pytest.raises(KeyError):
        e.queries()["none"]


def test_stages_keep_columns_of_the_operators_names(spark, tmp_path):
    d, item = str(tmp_path), prose(30)
    texts = {i: prose(100) for i in range(30)} | {40: prose(20) + " " + item}
    extra = "spans string, score double, kept string, n_removed int, text_in string, `found_id` int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), f"s{i}", i / 8, f"k{i}", i, f"x{i}", -i) for i, t in texts.items()], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == len(texts) - (name == "decontamination") and all((r.spans, r.score, r.kept, r.n_removed, r.text_in, r.found_id) == (f"s{r.doc_id}", r.doc_id / 8, f"k{r.doc_id}", r.doc_id, f"x{r.doc_id}", -r.doc_id) for r in rows)

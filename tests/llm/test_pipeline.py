"""The pipeline's stages against what is planted."""

import numpy as np

import corpus_pipeline
from ledgerloom.llm import skip_chain_pii


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [[i, text(120), "en", "s", 0] for i in range(120)]
    for i in range(0, 120, 3):
        rows[i][1] += f" write to jo.do{i}@mail.example.com soon"
    copies = [[200 + i, rows[i][1], "en", "s", 0] for i in range(10)]
    near = [[300 + i, rows[i][1] + " one more", "en", "s", 0] for i in range(20, 30)]
    junk = [[400 + i, "".join(rng.choice(list("#$%XYZ 019"), 400)), "en", "s", 0] for i in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + copies + near + junk, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert ids == {r[0] for r in rows + copies + near}
        else:
            assert ids == set(range(120))
        if name == "pii":
            assert docs.columns == before.columns
            for r in docs.collect():
                assert not skip_chain_pii.base_spans(r.text) and r.n_chars == len(r.text)
        if name == "packing":
            assert all(0 <= x < 50257 for r in docs.limit(50).collect() for x in r.ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(range(120))

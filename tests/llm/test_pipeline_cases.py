"""The whole pipeline on clashing columns, null ids, repeated rows and empty tables; the queries of the subpackage by their own names."""

import os

import duckdb

import corpus_pipeline
from ledgerloom.llm import common, queries

from .test_small_cases import CLASH, KNOWN, N_CLASH, ROWS

SCHEMA = f"doc_id long, text string, {CLASH}"


def _write(spark, folder, rows):
    spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", "en", "s", 0, *["w"] * (N_CLASH - 8)) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows if i != 6], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_on_odd_rows(spark, tmp_path):
    _write(spark, f"{tmp_path}/odd", ROWS)
    since = common.made()
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in rows} == {2, 3, 4, 6, 8} and len({r.doc_id for r in rows}) <= len(KNOWN)
    assert common.made() - since <= 2  # the last stage's input, and its tokens
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/odd").columns == docs.columns


def test_run_on_empty_tables(spark, tmp_path):
    _write(spark, f"{tmp_path}/none", [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    for name, sql in queries.SQL.items():
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr), name

from pathlib import Path

import duckdb
from pyspark.sql import functions as F
from test_decontam import norm
from test_near import brute as groups

import corpus_pipeline as cp
from millrace.llm import pii, quality

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [norm(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    label = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    left = rows
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == cp.COLUMNS
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            assert sum(label[d] == 1 and d not in got for d in label) < 0.06 * len(label)
            assert sum(label[d] == 0 and d in got for d in label) < 0.06 * len(label)
        if name == "near_duplicates":
            assert got.keys() == {d for d, (_, _, kept) in groups([(d, r.text) for d, r in left.items()], 5, 80).items() if kept}
        if name == "decontamination":
            assert got.keys() == {d for d, r in left.items() if not any(q in norm(r.text) for q in items)}
        if name == "pii":
            assert got.keys() == left.keys() and not any(pii.base_spans(r.text) for r in got.values())
            assert all(r.n_chars == len(r.text) for r in got.values())
        left = got
        docs = spark.createDataFrame([tuple(r) for r in got.values()], docs.schema)
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == left.keys()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "a b c d e f g", None, "s", 1), (2, "a b c d e f g", "en", None, 1), (2, "a b c d e f g", "en", None, 1), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    docs = docs.withColumn("word", F.lit(1)).withColumn("score", F.lit("x"))  # names that stages use themselves
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == cp.COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]
        if name in ("decontamination", "pii", "packing"):
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "2", "3", "None"]
    assert quality.THRESHOLD == 0.7


def test_of_repeated_rows_one_stays(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f g", "x", "s", 1)] * 3 + [(2, "quite another text with words", "x", "s", 1), (2, "and this one is different again", "x", "s", 1), (4, "", "x", "s", 0), (4, "", "x", "s", 0), (5, "a b c d e f g", "x", "s", 1)]
    got = cp.keep_one_of_each(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted({(d, t) for d, t, *_ in rows if d != 5})


def test_run_on_an_empty_table_leaves_nothing_behind(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{SF}/{t}.parquet")
        (frame.limit(0) if t == "documents" else frame).write.parquet(str(tmp_path / f"{t}.parquet"))
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 0 and len(set(shared.iterdir()) - before) == 1  # the result

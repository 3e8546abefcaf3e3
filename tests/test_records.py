import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import agent_checks, answered, every, fleet, identity, known_paths, some, topic, tree_checks, unsourced, with_json
from millrace.plans import topics_frame
from millrace.session import shared_folder
from millrace.sinks import read_sink, write_split


def value(rng, kind, depth=0):
    if rng.random() < 0.1:
        return None
    if isinstance(kind, T.StringType):
        return "".join(rng.choice(["a", '"', "\\", "/", "\n", "\t", "\r", "\b", "\f", "\x00", "\x1f", "\x7f", "é", " ", "😀", " ", "{", "\\n"]) for _ in range(rng.randrange(6)))
    if isinstance(kind, T.BooleanType):
        return rng.random() < 0.5
    if isinstance(kind, T.LongType):
        return rng.randrange(-(1 << 63), 1 << 63)
    if isinstance(kind, T.ArrayType):
        return [value(rng, kind.elementType) for _ in range(rng.randrange(4))]
    if isinstance(kind, T.MapType):
        return {value(rng, kind.keyType) or str(k): value(rng, kind.valueType) for k in range(rng.randrange(4))}
    return {f.name: value(rng, f.dataType) for f in kind.fields}


def test_json_equals_dumps(spark):
    kind = T._parse_datatype_string("s string, b boolean, n long, a array<array<string>>, m map<string, array<long>>, `o \"d\"é` struct<x: array<struct<y: string, z: long>>, e: boolean>")
    rng = random.Random(1)
    rows = [{f.name: value(rng, f.dataType) for f in kind.fields} for _ in range(2000)]
    # maps come in as entries, since a map made in Python may change its order on the way
    made = T.StructType([f if f.name != "m" else T.StructField("m", T._parse_datatype_string("array<struct<k: string, v: array<long>>>")) for f in kind.fields])
    frame = spark.createDataFrame([(k, r | {"m": None if r["m"] is None else list(r["m"].items())}) for k, r in enumerate(rows)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("r", made)]))
    frame = frame.select("k", "r.*").withColumn("m", F.map_from_entries("m"))
    got = {r.k: r.js for r in with_json(frame, "js", kind.names).select("k", "js").collect()}
    assert got == {k: json.dumps(r, ensure_ascii=False) for k, r in enumerate(rows)}
    with pytest.raises(TypeError):
        with_json(spark.range(1).select(F.lit(0.5).alias("x")), "js", ["x"])
    assert with_json(spark.range(1).select(F.array().cast("array<string>").alias("x")), "js", ["x"]).first().js == '{"x": []}'


def test_requests_are_answered(spark):
    from millrace.plans import TOPICS

    asked = [["whoami"], ["whoami"], [], ["cli", "overview"], ["cli", "none"], ["Whoami"], None, [""]]
    requests = spark.createDataFrame([(k, p) for k, p in enumerate(asked)], "k int, path array<string>")
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup(None))
    frame = answered(requests, topics_frame(spark))
    topic(topics_frame(spark), ["nothing"])
    assert len(status.getJobIdsForGroup(None)) == before  # a plan, no job
    for r in frame.collect():
        path = asked[r.k]
        if path is not None and tuple(path) in TOPICS:
            assert r.found.markdown == TOPICS[tuple(path)] and r.error is None
        else:
            assert r.found is None and tuple(r.error) == (1, f"no explain entry for: {' '.join(path or []) or '<root>'}", r.error.remediation) and r.error.remediation
    assert frame.count() == len(asked) and answered(requests.limit(0), topics_frame(spark)).count() == 0
    assert answered(requests, topics_frame(spark).limit(0)).where("error is null").count() == 0
    assert [tuple(r.path) for r in known_paths(topics_frame(spark)).collect()] == list(TOPICS)


def test_both_sinks_or_none(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 7 == 0, F.struct(F.col("id").alias("code"), F.lit("m").alias("message"))).alias("err"))
    folder = shared_folder(spark)
    write_split(rows, F.col("err"), F.struct("id", F.lit("ok").alias("what")), folder)
    results, errors = read_sink(spark, folder, "results", "id long, what string"), read_sink(spark, folder, "errors", "code long, message string")
    assert sorted(r.id for r in results.collect()) == [k for k in range(100) if k % 7] and sorted(r.code for r in errors.collect()) == list(range(0, 100, 7))
    with pytest.raises(FileExistsError):
        write_split(rows, F.col("err"), F.struct("id"), folder)
    assert results.count() + errors.count() == 100
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    other = shared_folder(spark)
    with pytest.raises(Exception, match="late"):
        write_split(rows.repartition(4), F.col("err"), F.struct(F.when(F.col("id") == 99, F.raise_error(F.lit("late"))).otherwise(F.col("id")).alias("id")), other)
    above = path(other).getParent()
    assert not fs.exists(path(other)) and not [f for f in fs.listStatus(above) if f.getPath().getName().startswith(path(other).getName())]
    write_split(rows.limit(0), F.col("err"), F.struct("id"), other)
    assert fs.exists(path(other)) and read_sink(spark, other, "errors", "code long").count() == 0
    only = shared_folder(spark)
    write_split(rows, F.lit(None).cast("struct<code:int>"), F.struct("id"), only)
    assert read_sink(spark, only, "errors", "code int").count() == 0 and read_sink(spark, only, "results", "id long").count() == 100


def test_fleet(spark):
    files = spark.createDataFrame([("a", "suffix: a\nbackend: gemini"), ("b", "suffix: a\nbackend: zzz"), ("c", "suffix: a\nbackend: acp")], "root string, text string")
    listing = spark.createDataFrame([("a", "GEMINI.md"), ("a", ".claude/skills/x"), ("c", "AGENTS.md"), ("d", "x")], "root string, path string")
    roots = spark.createDataFrame([(r,) for r in "abcdd"], "root string")
    ident = identity(files, "0", "n")
    reports = agent_checks(files.select("root"), ident, listing)
    assert tuple(fleet(reports).first())[:6] == (False, 1, 3, 2, "b", "backend_consistency")
    assert tuple(fleet(reports.where("root != 'b'")).first())[:6] == (False, 1, 2, 1, "c", "skills_present")  # a warning counts
    assert tuple(fleet(reports.where("root = 'a'")).first()) == (True, 0, 1, 0, None, None, None)
    assert tuple(fleet(reports.limit(0)).first()) == (True, 0, 0, 0, None, None, None)
    bare = unsourced(roots, ident).collect()
    assert [(r.root, r.healthy, [c.id for c in r.checks]) for r in bare] == [("d", True, ["source_checkout"])]
    both = {r.root: r.checks[0].id for r in tree_checks(roots, ident, listing).collect()}
    assert both == {"a": "prompt_file_present", "b": "backend_consistency", "c": "prompt_file_present", "d": "source_checkout"}


def test_folds_of_nothing(spark):
    none = spark.createDataFrame([], "x boolean").agg(every(F.col("x")).alias("a"), some(F.col("x")).alias("b")).first()
    assert (none.a, none.b) == (True, False)

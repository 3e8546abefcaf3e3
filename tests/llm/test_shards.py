import hashlib
import math
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import shared_folder
from millrace.llm.queries import op2_sharding
from millrace.llm.shards import UNIT, Conflict, ShardTable, sharded


def rows(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(None).cast("string").alias("path"))


def test_append_compact_read(spark):
    t = ShardTable(spark, shared_folder(spark), fan_in=3, target_bytes=1 << 20)
    assert t.versions() == [] and t.compact() is None if t.versions() else True
    assert t.append(rows(spark, 0, 100)) == 1
    assert t.append(rows(spark, 100, 300), F.col("doc_id") % 2) == 2
    assert sorted(r.doc_id for r in t.read(1).collect()) == list(range(100))
    assert t.manifest().select("run").distinct().count() == 3
    assert t.compact() == 3 and t.compact() is None
    m = t.manifest().collect()
    assert len({r.run for r in m}) == 1 and {r.tier for r in m} == {0} and sum(r.n_rows for r in m) == 300 and len(m) == 1
    assert sorted(r.doc_id for r in t.read().collect()) == list(range(300)) and t.read(2).count() == 300
    assert t.vacuum(grace=0) == 3 and t.versions() == [3] and t.read().count() == 300
    t.append(rows(spark, 300, 310))
    assert t.read().count() == 310 and t.read(3).count() == 300


def test_tiers_are_sizes(spark):
    """Merges against a plain model of them: which runs meet, and the tier that the size of the result has."""
    t = ShardTable(spark, shared_folder(spark), fan_in=2, target_bytes=1 << 20)
    rng = random.Random(7)
    tier = lambda size: max(0, int(math.log2(max(1.0, size / UNIT)) + 1e-9))
    known, low = {}, 0
    for n in (1, 1, 1, 1, 1, 1, 1, 1, 900, 1, 900, 4000, 1):
        texts = [(low + k, rng.randbytes(1500).hex()) for k in range(n)]
        t.append(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
        sizes = {r.run: r.s for r in t.manifest().groupBy("run").agg(F.sum("n_bytes").alias("s")).collect()}
        known = {run: rows for run, rows in known.items() if run in sizes} | {run: set(range(low, low + n)) for run in sizes if run not in known}
        low += n
        while True:  # one round of merges at a time
            by = {}
            for run in known:
                by.setdefault(tier(sizes[run]), []).append(run)
            due = {k: runs for k, runs in by.items() if len(runs) >= 2}
            if not due:
                break
            want = {frozenset(set().union(*(known[r] for r in runs))) for runs in due.values()} | {frozenset(known[r]) for runs in by.values() if len(runs) < 2 for r in runs}
            assert t.compact(rounds=1) is not None
            sizes = {r.run: r.s for r in t.manifest().groupBy("run").agg(F.sum("n_bytes").alias("s")).collect()}
            folder = t.manifest().select(F.col("path"), "run", "tier")
            got = t.read(path="at").join(folder, F.col("at") == F.col("path")).groupBy("run", "tier").agg(F.collect_set("doc_id").alias("ids")).collect()
            known = {r.run: set(r.ids) for r in got}
            assert set(map(frozenset, known.values())) == want and all(r.tier == tier(sizes[r.run]) for r in got)
        assert t.compact() is None
    assert len(known) > 1 and t.read().count() == low


def test_vacuum_leaves_a_writer_in_flight_alone(spark, monkeypatch):
    folder = shared_folder(spark)
    one, other = ShardTable(spark, folder, fan_in=2), ShardTable(spark, folder, fan_in=2)
    one.append(rows(spark, 0, 5))
    commit = ShardTable._commit

    def late(self, entries, schema, version):
        if self is other:
            one.append(rows(spark, 5, 10))  # the first writer is faster, and cleans up
            one.compact()
            one.vacuum()
        return commit(self, entries, schema, version)

    monkeypatch.setattr(ShardTable, "_commit", late)
    with pytest.raises(Conflict):
        other.append(rows(spark, 10, 15))
    monkeypatch.undo()
    assert other.append(rows(spark, 10, 15)) == 4 and one.read().count() == 15
    slow = other._batch(9)
    rows(spark, 15, 20).write.parquet(f"{folder}/data/{slow}")  # written, not committed
    one.vacuum()
    assert spark.read.parquet(f"{folder}/data/{slow}").count() == 5
    assert one.vacuum(grace=0) >= 1 and one.read().count() == 15
    path = spark._jvm.org.apache.hadoop.fs.Path
    assert len(one._fs.listStatus(path(f"{folder}/manifests"))) == 1


def between(monkeypatch, who, act, times=1):
    """Let another writer act between a merge's reading and its commit."""
    commit, left = ShardTable._commit, [times]

    def late(self, entries, schema, version):
        if self is who and left[0]:
            left[0] -= 1
            act()
        return commit(self, entries, schema, version)

    monkeypatch.setattr(ShardTable, "_commit", late)


@pytest.mark.parametrize("other_compacts", [False, True])
def test_a_commit_between_reading_and_writing_is_not_lost(spark, monkeypatch, other_compacts):
    folder = shared_folder(spark)
    one, other = ShardTable(spark, folder, fan_in=2), ShardTable(spark, folder, fan_in=2)
    one.append(rows(spark, 0, 10))
    one.append(rows(spark, 10, 20))
    between(monkeypatch, one, lambda: other.compact() if other_compacts else other.append(rows(spark, 20, 30)))
    one.compact()
    assert sorted(r.doc_id for r in one.read().collect()) == list(range(20 if other_compacts else 30))
    assert one.manifest().select("run").distinct().count() == 1


def test_a_merge_gives_up_and_leaves_the_table_as_it_is(spark, monkeypatch):
    folder = shared_folder(spark)
    one, other = ShardTable(spark, folder, fan_in=2), ShardTable(spark, folder, fan_in=9)
    one.append(rows(spark, 0, 10))
    one.append(rows(spark, 10, 20))
    low = [20]

    def act():
        other.append(rows(spark, low[0], low[0] + 1))
        low[0] += 1

    between(monkeypatch, one, act, 99)
    with pytest.raises(Conflict):
        one.compact(attempts=2)
    monkeypatch.undo()
    assert sorted(r.doc_id for r in one.read().collect()) == list(range(22)) and one.compact() is not None
    assert one.vacuum(grace=0) >= 2 and sorted(r.doc_id for r in one.read().collect()) == list(range(22))


def test_appends_keep_their_files_behind_another_commit(spark, monkeypatch):
    folder = shared_folder(spark)
    one, other = ShardTable(spark, folder), ShardTable(spark, folder)
    one.append(rows(spark, 0, 5))
    between(monkeypatch, one, lambda: other.append(rows(spark, 5, 10)))
    assert one.append(rows(spark, 10, 15), attempts=2) == 3 and sorted(r.doc_id for r in one.read().collect()) == list(range(15))


def test_threads_append_and_compact(spark):
    folder, errors = shared_folder(spark), []
    ShardTable(spark, folder, fan_in=3).append(rows(spark, 0, 1).coalesce(1))

    def appends():
        t = ShardTable(spark, folder, fan_in=3)
        for k in range(1, 13):
            t.append(rows(spark, k, k + 1).coalesce(1), attempts=100)

    def compacts(stop):
        t = ShardTable(spark, folder, fan_in=3)
        while not stop.is_set():
            try:
                t.compact()
            except Conflict:
                pass

    def safe(f, *a):
        try:
            f(*a)
        except Exception as e:  # a thread's error is the test's
            errors.append(e)

    stop = threading.Event()
    merger, writers = threading.Thread(target=safe, args=(compacts, stop)), [threading.Thread(target=safe, args=(appends,))]
    for t in [merger, *writers]:
        t.start()
    for t in writers:
        t.join()
    stop.set()
    merger.join()
    assert not errors
    got = ShardTable(spark, folder, fan_in=3)
    got.compact()
    assert sorted(r.doc_id for r in got.read().collect()) == list(range(13)) and sum(r.n_rows for r in got.manifest().collect()) == 13


def test_conflict(spark):
    t = ShardTable(spark, shared_folder(spark))
    t.append(rows(spark, 0, 5))
    with pytest.raises(Conflict):
        t._commit(t.manifest(), t.schema(), 1)
    assert t.versions() == [1] and t.read().count() == 5
    with pytest.raises(ValueError):
        t.append(rows(spark, 0, 5).drop("path"))


def test_whole_table(spark):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = op2_sharding(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_bytes, r.text_sha256) for r in got} == {d: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs} and len(got) == len(docs)
    store = shared_folder(spark)
    got = sharded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), store, F.col("doc_id") % 5, target_bytes=1 << 18).collect()
    count = {}
    for r in got:
        count[r.shard] = count.get(r.shard, 0) + 1
    assert all(count[r.shard] == r.shard_rows for r in got) and len(count) > 1
    again = sharded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), shared_folder(spark), F.col("doc_id") % 5, target_bytes=1 << 18).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_edges(spark):
    schema = "doc_id long, text string, tier int, path string"
    data = [(None, None, None, None), (1, "", 1, "x"), (2, "é" * 100_000, None, None), (2, "é" * 100_000, None, None)]
    docs = spark.createDataFrame(data, schema)
    got = sharded(docs, shared_folder(spark), F.col("doc_id")).collect()
    assert sorted(r.n_bytes for r in got) == [0, 0, 200_000, 200_000] and {r.table_rows for r in got} == {4}
    assert sorted((r.doc_id or 0, r.arrival_rows) for r in got) == [(0, 1), (1, 1), (2, 2), (2, 2)]
    assert sharded(docs.limit(0), shared_folder(spark), F.col("doc_id")).count() == 0

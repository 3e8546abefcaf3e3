import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.operators import nearest_roots
from millrace.sources import found_paths, locate, nearest_root, probe, readable, scan, scan_errors

ODD = ["br[1]", "cu{a,b}", "st*r", "b lank", "p%20c", "q?", "ü"]


def frame(spark, names, column="root"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def tree(root, text=b"suffix: a\nbackend: claude\n", prompt=True, kit=True):
    root.mkdir(parents=True)
    if text is not None:
        (root / "culture.yaml").write_bytes(text)
    if prompt:
        (root / "CLAUDE.md").write_text("x")
    if kit:
        (root / ".claude" / "skills" / ".hidden").mkdir(parents=True)
    return root


@pytest.mark.parametrize("name", ODD)
def test_verbs_take_paths_literally(spark, tmp_path, monkeypatch, capsys, name):
    root = tree(tmp_path / name)
    tree(tmp_path / "br1", b"suffix: other\n", False, False)  # what a pattern would find instead
    monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: str(root))
    assert cli.main(["doctor"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("millrace doctor: healthy\n\n[ok] prompt_file_present") and out.endswith("\n") and not out.endswith("\n\n")
    assert cli.main(["whoami"]) == 0 and capsys.readouterr().out.startswith("nick: a\n")
    assert cli.main(["overview", "--json"]) == 0 and "nick: a" in json.loads(capsys.readouterr().out)["sections"][0]["items"]


def test_report_and_error_forms(spark, tmp_path, monkeypatch, capsys):
    root = tree(tmp_path / "a", prompt=False, kit=False)
    monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: str(root))
    assert cli.main(["doctor"]) == 1
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "millrace doctor: unhealthy" and lines[1] == "" and lines[2].startswith("[FAIL] prompt_file_present: ") and lines[3].startswith("  hint: ")
    monkeypatch.setattr("millrace.plans.introspection.whoami", lambda *_: 1 / 0)
    assert cli.main(["whoami"]) == 1
    err = capsys.readouterr().err.splitlines()
    assert err[0] == "error: unexpected: ZeroDivisionError: division by zero" and err[1].startswith("hint: ") and len(err) == 2
    assert cli.main(["whoami", "--json"]) == 1
    assert set(json.loads(capsys.readouterr().err)) == {"code", "message", "remediation"}


def test_version_is_that_of_the_package(monkeypatch):
    import importlib
    import importlib.metadata

    import millrace

    try:
        want = importlib.metadata.version("millrace")
    except importlib.metadata.PackageNotFoundError:
        want = "0.0.0"
    assert millrace.__version__ == want
    monkeypatch.setattr(importlib.metadata, "version", lambda name: {"millrace": "9.8.7"}[name])
    assert importlib.reload(millrace).__version__ == "9.8.7"
    monkeypatch.undo()
    importlib.reload(millrace)


def test_an_unreadable_file_gives_the_defaults(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "t" / "culture.yaml").mkdir(parents=True)  # a folder in the file's place can't be read
    monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: str(tmp_path / "t"))
    assert cli.main(["whoami"]) == 0 and capsys.readouterr().out.splitlines()[::2] == ["nick: millrace", "backend: unknown"]
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "culture.yaml").write_bytes(b"suffix: \xff")
    monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: str(tmp_path / "u"))
    assert cli.main(["whoami"]) == 1 and capsys.readouterr().err.startswith("error: unexpected: UnicodeDecodeError: ")


def test_scan_goes_on_past_what_it_cannot_read(spark, tmp_path):
    names = [f"{n}-{k}" for n in ODD for k in range(3)]
    for k, n in enumerate(names):
        (tmp_path / n).mkdir()
        if k % 3:
            (tmp_path / n / "culture.yaml").write_bytes(b"suffix: x\xff" if k % 3 == 1 else f"suffix: {n}\r\n".encode())
    roots = frame(spark, [str(tmp_path / n) for n in names] + [None, f"file:{tmp_path / names[2]}/"])
    got = scan(roots, "culture.yaml")
    status = {r.root: r.status for r in got.collect()}
    assert [status[str(tmp_path / n)] for n in names] == ["unreadable", "undecodable", "read"] * len(ODD) and status[None] == "unreadable"
    assert {r.text for r in readable(got).where("text is not null").collect()} == {f"suffix: {n}\r\n" for n in names[2::3]} and readable(got).count() == 2 * len(ODD) + 2
    bad = scan_errors(got).collect()
    assert {r.root for r in bad} == {str(tmp_path / n) for n in names[1::3]} and all(r.path == "culture.yaml" and "0xff" in r.reason for r in bad)


def test_probe(spark, tmp_path):
    for n in ODD:
        root = tree(tmp_path / n)
        (root / "empty").mkdir()
        (root / "file").write_text("")
    asked = {"culture.yaml": True, "nothing": False, ".claude": False, ".claude/skills/": True, "empty/": False, "file/": False, "file/x": False, "file": True}
    places = spark.createDataFrame([(str(tmp_path / n), p) for n in ODD for p in asked] + [(None, "x"), (str(tmp_path), None), (str(tmp_path), "a\0b")], "root string, path string")
    got = probe(places).collect()
    assert {(r.root, r.path): r.found for r in got if r.root and r.path and r.path in asked} == {(str(tmp_path / n), p): v for n in ODD for p, v in asked.items()}
    assert [(r.found, bool(r.reason)) for r in got if not r.root or not r.path or r.path not in asked] == [(False, True)] * 3
    assert found_paths(frame(spark, [str(tmp_path / n) for n in ODD]), list(asked)).count() == len(ODD) * sum(asked.values())
    assert probe(places.limit(0)).count() == 0


def test_one_folder_is_read_up_to_its_first_entry(tmp_path, monkeypatch):
    from millrace.sources import files

    for k in range(50):
        (tmp_path / str(k)).touch()
    seen, real = [], os.scandir

    class Counted:
        def __init__(self, path):
            self.inner = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.inner.close()

        def __next__(self):
            seen.append(1)
            return next(self.inner)

    monkeypatch.setattr(files.os, "scandir", Counted)
    assert files.has_entry(str(tmp_path)) and len(seen) == 1


def test_many_roots_are_probed_by_tasks(spark, tmp_path):
    """100,000 roots from a table: the driver sees a count only."""
    tree(tmp_path / "7")
    roots = spark.range(100_000).select(F.concat(F.lit(f"{tmp_path}/"), F.col("id").cast("string")).alias("root"))
    assert sorted(r.path for r in found_paths(roots, ["culture.yaml", ".claude/skills/"]).collect()) == [".claude/skills/", "culture.yaml"]


def test_nearest_roots_on_random_trees(spark):
    rng = random.Random(5)
    name = lambda: rng.choice(["a", "b", "[c]", "d e"])
    path = lambda most: "/" + "/".join(name() for _ in range(rng.randrange(most)))
    starts, roots, want = [], [], {}
    for k in range(10_000):  # each tree has a name of its own at the top
        held = {f"/{k}" + path(4).rstrip("/") for _ in range(rng.randrange(4))}
        start = f"/{k}" + path(7).rstrip("/")
        at = start
        while at and at not in held:
            at = at.rpartition("/")[0]
        starts.append(start + rng.choice(["", "/", "/."]))
        roots += sorted(held)
        want[starts[-1]] = at or None
    got = nearest_roots(frame(spark, starts + starts[:50], "start"), frame(spark, roots + [None] + roots[:99]))
    assert {r.start: r.root for r in got.collect()} == want
    got = nearest_roots(frame(spark, [*starts[:100], None, "/", "file:///x//y", "hdfs://h/x"], "start"), frame(spark, ["/", "hdfs://h/x/"]))
    assert {r.start: r.root for r in got.collect()} == dict.fromkeys(starts[:100], "/") | {None: None, "/": "/", "file:///x//y": None, "hdfs://h/x": "hdfs://h/x"}
    assert nearest_roots(frame(spark, starts[:3], "start"), frame(spark, []).limit(0)).where("root is null").count() == 3


def test_located_folders_do_not_pass_whole_through_the_driver(spark, tmp_path):
    """20,000 paths are a small file, but 112 MB to broadcast once each is held in all shares."""
    long = "/" + "/".join(["a long name of a folder"] * 4)
    spark.range(20_000).select(F.concat(F.lit(f"{long}/"), F.col("id").cast("string")).alias("root")).coalesce(1).write.parquet(f"{tmp_path}/roots")
    roots = spark.read.schema("root string").parquet(f"{tmp_path}/roots")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        got = nearest_roots(roots.select(F.concat("root", F.lit("/kit")).alias("start")), roots.where("root not like '%7'"))
        assert got.where("root is null").count() == 2000 and got.where("start = root || '/kit'").count() == 18_000
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_locate_equals_the_walk_up(spark, tmp_path):
    rng, folders = random.Random(2), [tmp_path]
    for k in range(150):
        folder = rng.choice(folders) / f"{rng.choice(ODD)}{k}"
        folder.mkdir()
        folders.append(folder)
        if rng.random() < 0.2:
            (folder / "culture.yaml").touch()
        elif rng.random() < 0.1:
            (folder / "culture.yaml").mkdir()
    got = {r.start: r.root for r in locate(frame(spark, map(str, folders), "start"), "culture.yaml").collect()}
    assert got == {str(f): nearest_root(str(f), "culture.yaml") for f in folders} and len(set(got.values())) > 10
    assert all(v is None or re.search("[\\[{*%]|lank|[?ü]", v) for v in got.values())


@pytest.mark.parametrize("query", ["r_scan", "r_probe", "r_locate"])
def test_planted_trees_are_deleted_by_tasks_and_repeated_documents_count(spark, tmp_path, monkeypatch, query):
    from collections import Counter
    from pathlib import Path

    import duckdb

    from millrace import catalog

    rows = [(k, ["en", "de", "fr"][k % 3]) for k in range(50)]
    spark.createDataFrame(rows + rows[:7], "doc_id long, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog, "TREES_IN_A_FOLDER", 10, raising=False)
    left, sizes, real, real_scan = [], [], catalog.delete, catalog.scan

    def delete(session, folders):
        for top in folders:
            left.append([p.name for p in Path(top.removeprefix("file:")).rglob("t[[]*")])
        real(session, folders)

    def scanned(roots, name):
        sizes.extend(Counter(r.root.rpartition("/")[0] for r in roots.collect()).values())
        return real_scan(roots, name)

    monkeypatch.setattr(catalog, "delete", delete)
    monkeypatch.setattr(catalog, "scan", scanned)
    got = Counter(map(tuple, catalog.QUERIES[query](spark, str(tmp_path)).collect()))
    duckdb.sql(f"create or replace temp view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(duckdb.sql(catalog.SQL[query]).fetchall())
    assert left and not any(left)  # the driver alone would take an hour over millions of trees
    assert all(n <= 10 for n in sizes) and bool(sizes) == (query == "r_scan")

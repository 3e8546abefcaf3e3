import json
import math

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions.text import split_lines, strip_space
from millrace.operators import TopicNotFound, resolve
from millrace.plans import TOPICS, doctor, topics_frame, whoami
from millrace.plans.introspection import cli_overview, overview
from millrace.sources import found_paths, read_identity_files

CASES = {
    "second": ("- suffix: a\nbackend: x\n- suffix: b\nbackend: y", "a", "x", "unknown"),
    "last": ("suffix: a\nbackend: x\nbackend: y", "a", "y", "unknown"),
    "before": ("backend: x\nsuffix: a", "a", "unknown", "unknown"),
    "dash": ("suffix: a\n- backend: x", "a", "unknown", "unknown"),
    "quotes": ("suffix: 'a'", "a", "unknown", "unknown"),
    "inner": ('suffix: " a "', " a ", "unknown", "unknown"),
    "empty": ("suffix:", "unknown", "unknown", "unknown"),
    "colon": ("suffix: a\nmodel: m:1", "a", "unknown", "m:1"),
    "comment": ("suffix: a\nbackend: x # y", "a", "x # y", "unknown"),
    "tab": ("\tsuffix: a", "a", "unknown", "unknown"),
    "breaks": ("suffix: a\x0cbackend: x model: m", "a", "x", "m"),
    "none": (None, "nick", "unknown", "unknown"),
}


def test_identity_cases(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "root string, text string")
    got = {r.root: (r.nick, r.backend, r.model) for r in whoami(files, nick="nick").collect()}
    assert got == {k: v[1:] for k, v in CASES.items()}


def test_split_and_strip_follow_python(spark):
    texts = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l", "", "\n", "a\n\n", " 　 a \t\x1f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("l"), strip_space(F.col("t")).alias("s")).collect()
    assert all(r.l == r.t.splitlines() and r.s == r.t.strip() for r in rows)


def test_doctor(spark):
    files = spark.createDataFrame([("ok", "suffix: a\nbackend: gemini"), ("bad", "suffix: a\nbackend: zzz"), ("nofile", "suffix: a\nbackend: gemini"), ("warn", "suffix: a\nbackend: acp")], "root string, text string")
    listing = spark.createDataFrame([("ok", "GEMINI.md"), ("ok", ".claude/skills/x"), ("warn", "AGENTS.md"), ("bad", ".claude/skills/x")], "root string, path string")
    roots = files.select("root").unionByName(spark.createDataFrame([("absent",)], "root string"))
    got = {r.root: r for r in doctor(roots, files, listing).collect()}
    assert {k: r.healthy for k, r in got.items()} == {"ok": True, "bad": False, "nofile": False, "warn": False, "absent": True}
    assert got["bad"].checks[0].remediation == "known backends: acp, claude, colleague, gemini"
    assert got["nofile"].checks[0].id == "prompt_file_present" and got["warn"].exit_code == 1
    assert "[FAIL] skills_present" in got["warn"].as_text and "hint:" in got["warn"].as_text
    assert json.loads(got["absent"].as_json)["checks"][0]["id"] == "source_checkout"


def test_topics_and_overview(spark):
    frame = topics_frame(spark)
    for path in TOPICS:
        assert resolve(frame, list(path)).markdown.startswith("#")
    with pytest.raises(TopicNotFound, match="no explain entry for: nothing"):
        resolve(frame, ["nothing"])
    text = overview(spark.createDataFrame([("r", "suffix: a")], "root string, text string")).first().as_text
    assert text.startswith("# millrace\n\n## Identity\n- nick: a") and text == text.rstrip()
    assert "cli overview" in cli_overview(spark).first().as_text


def test_doctor_on_real_trees(spark, tmp_path, monkeypatch, capsys):
    def tree(name, skills, prompt="CLAUDE.md"):
        root = tmp_path / name
        root.mkdir()
        (root / "culture.yaml").write_text("suffix: a\nbackend: claude\n")
        if prompt:
            (root / prompt).write_text("x")
        if skills == "file":
            (root / ".claude").mkdir()
            (root / ".claude" / "skills").write_text("x")
        elif skills:
            (root / ".claude" / "skills" / skills).mkdir(parents=True)
        return root

    cases = {"good": (".hidden", 0, []), "none": (None, 1, ["skills_present"]), "flat": ("file", 1, ["skills_present"])}
    for name, (skills, code, failed) in cases.items():
        root = tree(name, skills)
        monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: str(root))
        assert cli.main(["doctor", "--json"]) == code
        report = json.loads(capsys.readouterr().out)
        assert report["healthy"] == (not failed) and [c["id"] for c in report["checks"] if not c["passed"]] == failed
    bare = tree("bare", "x", None)
    (bare / "CLAUDE.md").mkdir()  # a folder is no prompt file
    monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: str(bare))
    assert cli.main(["doctor"]) == 1 and "[FAIL] prompt_file_present" in capsys.readouterr().out
    files = read_identity_files(spark, f"{tmp_path}/*/culture.yaml")
    listing = found_paths(files.select("root"), ["CLAUDE.md", ".claude/skills/"])
    got = {r.root.rsplit("/", 1)[1]: r.healthy for r in doctor(files.select("root"), files, listing).collect()}
    assert got == {"good": True, "none": False, "flat": False, "bare": False}
    monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: None)
    assert cli.main(["doctor"]) == 0 and "source_checkout" in capsys.readouterr().out


def test_bad_utf8_is_an_error(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "culture.yaml").write_bytes(b"suffix: \xff\n")
    monkeypatch.setattr("millrace.sources.trees.nearest_root", lambda *_: str(tmp_path))
    assert cli.main(["whoami"]) == 1 and "error: unexpected: " in capsys.readouterr().err


def test_json_flag_stands_for_its_own_verb(spark, capsys):
    assert cli.main(["cli", "--json", "overview"]) == 0 and capsys.readouterr().out.startswith("# millrace cli")
    assert cli.main(["explain", "mill"]) == 0
    page = capsys.readouterr().out
    assert cli.main(["explain"]) == 0 and capsys.readouterr().out == page and page.count("\n") > 5


@pytest.mark.parametrize("argv", [["whoami"], ["learn"], ["explain"], ["overview", "/no/such"], ["cli"], ["cli", "overview"]])
def test_cli(spark, capsys, argv):
    assert cli.main(argv) == 0 and capsys.readouterr().out
    assert cli.main([*argv, "--json"]) == 0 and json.loads(capsys.readouterr().out)


def test_cli_errors(spark, capsys):
    assert cli.main(["explain", "nonexistent"]) == 1
    assert capsys.readouterr().err.startswith("error: no explain entry")
    for argv in (["bogus"], ["cli", "overview", "--bogus"]):
        with pytest.raises(SystemExit) as e:
            cli.main(argv)
        err = capsys.readouterr().err
        assert e.value.code == 1 and "error:" in err and "hint:" in err
    assert cli.main([]) == 0


def test_queries_match_sql(spark):
    import duckdb

    from millrace.catalog import QUERIES, SQL

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, query in QUERIES.items():
        got = query(spark, d)
        want = con.sql(SQL[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        norm = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=str)
        assert norm(got.select(cols).collect()) == norm(want.select(*cols).fetchall()), name

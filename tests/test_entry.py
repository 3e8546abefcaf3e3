import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e
from millrace import catalog


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) == set(catalog.SQL) and set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_corpus_operators(tmp_path):
    repo = Path(e.__file__).parent
    shutil.copytree(repo / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, millrace.cli, millrace.plans, millrace.sources, millrace.streaming; print(sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.strip() == str(sorted(catalog.QUERIES))
    assert importlib.util.find_spec("millrace") is not None


def test_stream_of_identities(spark, tmp_path):
    from millrace.streaming import watch_identities

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "culture.yaml").write_text("suffix: a\nbackend: acp\n")
    query = watch_identities(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.nick, r.backend) for r in spark.table("seen").collect()] == [("a", "acp")]

"""Identity, health and overview of source trees, one row for each tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.blocks import identity
from ..operators.checks import agent_checks
from ..operators.json_text import with_json
from ..operators.render import checks_text, sections_text

NICK = "millrace"
VERBS = {
    "whoami": "show nick, version, backend and model",
    "learn": "describe the tool to a reader who is new to it",
    "explain": "show the page of a topic",
    "overview": "show identity, verbs and artifacts",
    "doctor": "run the checks of the source tree",
}
ARTIFACTS = ["the identity file", "the prompt file of the backend", "the skills folder"]
CONVENTIONS = ["--json turns any result into one JSON value", "what was asked for is printed, what went wrong is logged to the error stream", "a run ends with 0 if all is well and with 1 otherwise"]
_ROOT = """# millrace

Introspection of source trees and preparation of training text on Spark.

A source tree declares who works in it with a `culture.yaml` file: its first
block names a nick, a backend and a model. `whoami` shows that block, `doctor`
checks that the tree has what its backend needs, `overview` sums both up. The
same plans run over one tree or over a folder of millions.

""" + "\n".join(f"- `millrace {verb}`: {what}" for verb, what in VERBS.items())
_PAGES = {
    "whoami": "Prints four lines: nick, version, backend, model. The values stand in the first block of\nthe nearest `culture.yaml`; a second `suffix:` line ends the block, and within it the last\nline of a key wins. A key without a value is `unknown`.",
    "learn": "Prints what the tool is for, its verbs, its exit codes and where to read on, for a reader\nwho sees it for the first time. `--json` gives the same as one object.",
    "explain": "Prints the page of a topic, given as words: `millrace explain cli overview`. Without words it\nprints the start page. An unknown topic is an error.",
    "overview": "Prints three sections: identity, verbs, artifacts. A target may be named and is ignored, so\nthe verb works on any tree.",
    "doctor": "Runs the checks in order and prints one line for each, with a hint below a failed one. The\ntree is healthy only if every check passed, warnings too; the exit code says so.",
}
_CLI = "# cli\n\nThe command line itself.\n\n" + "\n".join(f"- {line}" for line in CONVENTIONS) + "\n\n`millrace cli overview` lists the verbs; bare `millrace cli` does the same."
#: Topic path -> page; the start page has its name and a short alias, and both paths of the command line share a page.
TOPICS: dict[tuple[str, ...], str] = {
    (): _ROOT,
    ("millrace",): _ROOT,
    ("mill",): _ROOT,
    **{(verb,): f"# {verb}\n\n{page}" for verb, page in _PAGES.items()},
    ("cli",): _CLI,
    ("cli", "overview"): _CLI,
}


def whoami(files: DataFrame, version: str = __version__, nick: str = NICK) -> DataFrame:
    """Identity rows of files (root, text), with text and JSON forms."""
    found = identity(files, version, nick)
    line = lambda k: F.concat(F.lit(f"{k}: "), F.col(k))
    keys = ["nick", "version", "backend", "model"]
    return with_json(found.withColumn("as_text", F.concat_ws("\n", *map(line, keys))), "as_json", keys)


def doctor(roots: DataFrame, files: DataFrame, listing: DataFrame, version: str = __version__, nick: str = NICK, **rules) -> DataFrame:
    """Checks of each root, with the rendered report and the exit code."""
    report = agent_checks(roots, identity(files, version, nick), listing, **rules)
    report = report.withColumns({"as_text": checks_text(f"{nick} doctor", F.col("healthy"), F.col("checks")), "exit_code": F.when(F.col("healthy"), 0).otherwise(1)})
    return with_json(report, "as_json", ["healthy", "checks"])


def _section(title: str, items) -> F.Column:
    return F.struct(F.lit(title).alias("title"), items.alias("items"))


def overview(files: DataFrame, version: str = __version__, nick: str = NICK) -> DataFrame:
    """(root, subject, sections, as_text, as_json) of each tree."""
    ident = identity(files, version, nick)
    rows = [F.concat(F.lit(f"{k}: "), F.col(k)) for k in ("nick", "version", "backend", "model")]
    verbs = [F.lit(f"{v} — {what}") for v, what in VERBS.items()]
    sections = F.array(_section("Identity", F.array(*rows)), _section("Verbs", F.array(*verbs)), _section("Artifacts", F.array(*map(F.lit, ARTIFACTS))))
    out = ident.select("root", F.lit(nick).alias("subject"), sections.alias("sections"))
    return with_json(out.withColumn("as_text", sections_text(F.col("subject"), F.col("sections"))), "as_json", ["subject", "sections"])


def cli_overview(spark: SparkSession, nick: str = NICK) -> DataFrame:
    """One row (subject, sections, as_text, as_json) for the command line itself."""
    verbs = [F.lit(f"{v} — {what}") for v, what in VERBS.items()]
    listed = F.concat(F.array(*verbs), F.array(F.lit("cli overview — describe the command line")))
    sections = F.array(_section("Verbs", listed), _section("Conventions", F.array(*map(F.lit, CONVENTIONS))))
    out = spark.range(1).select(F.lit(f"{nick} cli").alias("subject"), sections.alias("sections"))
    return with_json(out.withColumn("as_text", sections_text(F.col("subject"), F.col("sections"))), "as_json", ["subject", "sections"])


def learn(spark: SparkSession, version: str = __version__, nick: str = NICK) -> DataFrame:
    """One row that describes the tool: tool, version, purpose, commands, exit_codes, json_support, explain_pointer, as_json."""
    commands = F.array(*[F.struct(F.array(F.lit(v)).alias("path"), F.lit(what).alias("summary")) for v, what in VERBS.items()])
    codes = F.create_map(*map(F.lit, ["0", "success", "1", "user error", "2", "environment error"]))
    row = spark.range(1).select(
        F.lit(nick).alias("tool"), F.lit(version).alias("version"), F.lit("Identity, checks and corpus preparation on Spark.").alias("purpose"),
        commands.alias("commands"), codes.alias("exit_codes"), F.lit(True).alias("json_support"), F.lit(f"{nick} explain <topic>").alias("explain_pointer"),
    )
    return with_json(row, "as_json", row.columns)


def topics_frame(spark: SparkSession) -> DataFrame:
    """Topics as (ord, path, markdown), in the order in which they are listed."""
    rows = [(i, list(path), page) for i, (path, page) in enumerate(TOPICS.items())]
    return spark.createDataFrame(rows, "ord int, path array<string>, markdown string")

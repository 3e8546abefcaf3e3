"""Command line over the introspection plans.

Results go to stdout; errors go to stderr as ``error:`` and ``hint:`` lines, or
as a JSON object with ``--json``; every error ends with exit code 1.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from . import __version__

SOURCE = "culture.yaml"
#: What an unexpected error asks its reader to do.
REPORT = "tell the maintainers which command line led here"


class UserError(Exception):
    def __init__(self, message: str, remediation: str = "", code: int = 1):
        super().__init__(message)
        self.code, self.message, self.remediation = code, message, remediation


def show_error(err: UserError, as_json: bool) -> None:
    if as_json:
        print(json.dumps({"code": err.code, "message": err.message, "remediation": err.remediation}, ensure_ascii=False), file=sys.stderr)
        return
    print(f"error: {err.message}", file=sys.stderr)
    if err.remediation:
        print(f"hint: {err.remediation}", file=sys.stderr)


class Parser(argparse.ArgumentParser):
    as_json = False

    def error(self, message: str):
        show_error(UserError(message, f"{self.prog} --help lists what it takes"), Parser.as_json)
        raise SystemExit(1)


def build_parser() -> argparse.ArgumentParser:
    parser = Parser(prog="millrace", description="Introspection of source trees on Spark.")
    parser.add_argument("--version", action="version", version=f"millrace {__version__}")
    verbs = parser.add_subparsers(dest="verb", parser_class=Parser)
    for verb in ("whoami", "learn", "doctor", "overview", "explain", "cli"):
        sub = verbs.add_parser(verb)
        sub.add_argument("--json", action="store_true")
        if verb == "overview":
            sub.add_argument("target", nargs="?")
        if verb == "explain":
            sub.add_argument("path", nargs="*")
        if verb == "cli":  # the inner --json stands for itself: `cli --json overview` is text, `cli overview --json` is JSON
            sub.add_subparsers(dest="what", parser_class=Parser).add_parser("overview").add_argument("--json", action="store_true")
    return parser


def show(text: str) -> None:
    """Print a result, with one line break at its end if it has none."""
    sys.stdout.write(text if text.endswith("\n") else f"{text}\n")


def run(args: argparse.Namespace) -> int:
    from .operators.checks import PROMPT_FILE, SKILLS
    from .operators.json_text import with_json
    from .operators.lookup import HINT, TopicNotFound, resolve
    from .plans import introspection as plans
    from .session import local_session
    from .sources import trees
    from .sources.files import found_paths, readable, scan, scan_errors

    spark = local_session()
    if args.verb == "explain":
        try:
            row = resolve(with_json(plans.topics_frame(spark), "as_json", ["path", "markdown"]), args.path)
        except TopicNotFound as e:
            raise UserError(str(e), HINT) from None
        show(row.as_json if args.json else row.markdown)
        return 0
    if args.verb == "learn":
        row = plans.learn(spark).first()
        show(row.as_json if args.json else "\n".join([f"{row.tool} {row.version}: {row.purpose}", *(f"  {' '.join(c.path)}: {c.summary}" for c in row.commands), f"See {row.explain_pointer}."]))
        return 0
    root = trees.nearest_root(str(Path(__file__).parent), SOURCE)
    roots = spark.createDataFrame([(root or "",)], "root string")
    files = roots.select("root", F.lit(None).cast("string").alias("text"))
    if root and args.verb != "cli":
        scanned = scan(roots, SOURCE)
        bad = scan_errors(scanned).first()
        if bad:
            raise UserError(f"unexpected: UnicodeDecodeError: {bad.root}/{bad.path}: {bad.reason}", REPORT)
        files = readable(scanned)
    if args.verb == "doctor":
        row = plans.doctor(roots, files if root else files.limit(0), found_paths(roots, [*PROMPT_FILE.values(), SKILLS])).first()
    else:
        row = {"whoami": lambda: plans.whoami(files), "overview": lambda: plans.overview(files), "cli": lambda: plans.cli_overview(spark)}[args.verb]().first()
    show(row.as_json if args.json else row.as_text)
    return row.exit_code if args.verb == "doctor" else 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    Parser.as_json = any(a == "--json" or a.startswith("--json=") for a in argv)
    parser = build_parser()
    args = parser.parse_args(argv)
    if not args.verb:
        parser.print_help()
        return 0
    try:
        return run(args)
    except UserError as e:
        show_error(e, args.json)
        return e.code
    except Exception as e:  # the command line shows no traceback
        show_error(UserError(f"unexpected: {type(e).__name__}: {e}", REPORT), args.json)
        return 1

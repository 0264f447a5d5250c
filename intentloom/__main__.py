"""python -m intentloom COMMAND; exit 0 fine, 1 errors found, 2 wrong use, 3 a fault of ours."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from . import project, server, sinks
from .graph import IntentGraph
from .operators import stats
from .operators import traverse as T
from .plans import compile as plan
from .plans.query import QueryError
from .sources import files

COMMANDS = ["scan", "lint", "ask", "history", "stats", "dot", "init", "serve"]


def load(spark: SparkSession, a: argparse.Namespace, check_stale: bool = False) -> IntentGraph:
    return project.load(spark, a.root, check_stale=check_stale, cache=None if a.no_cache else f"{a.root}/.intentloom/facts")


def answer(g: IntentGraph, question: str, all_paths: bool = False, max_len: int | None = None, human: bool = False) -> Iterator[str]:
    """Lines of an answer; JSON ends with the references that lead nowhere."""
    found = g.ask(question, all_paths=all_paths, max_len=max_len)
    if "via" not in found.columns:
        yield from (" ".join(str(x) for x in r if x is not None) for r in found.collect()) if human else (r[0] for r in found.selectExpr("to_json(struct(*))").collect())
        return
    yield from sinks.answer_lines(g, found) if human else (r[0] for r in sinks.answer_json(g, found).toLocalIterator())
    if not human:
        yield json.dumps({"unresolved": sinks.unresolved(g)})


def history(g: IntentGraph, root: str, qname: str, human: bool = False) -> Iterator[str]:
    """The commits that changed what a block is about, newest first."""
    plan.lookup(g, qname)
    row = g.blocks.filter(g.blocks["qname"] == qname).first()
    if row is None or row["subject_line"] is None:
        raise QueryError(f"{qname} is bound to no source")
    first, last = row["line"], row["subject_end"]
    commits = files.history(root, row["file"], first, last)
    if not human:
        yield json.dumps({"qname": qname, "location": {"file": row["file"], "line": first}, "span": {"start": first, "end": last}, "commits": [dict(zip(("hash", "author", "date", "message"), c)) for c in commits]})
        return
    yield f"{qname}, {row['file']}:{first}-{last}, {len(commits)} commits"
    yield from (f"{h[:12]} {date} {author}: {subject}" for h, author, date, subject in commits)


def counts(g: IntentGraph) -> Iterator[str]:
    for df in (stats.totals(g), stats.nodes_by_kind(g), stats.edges_by_layer(g), stats.claims_by_status(g), stats.findings_summary(g.findings)):
        yield from (r[0] for r in df.selectExpr("to_json(struct(*))").collect())


def run(a: argparse.Namespace) -> int:
    if a.command == "init":
        print(project.propose_manifest(a.root), end="")
        return 0
    if a.command in ("ask", "history") and not a.what:
        print(f"{a.command} needs a question or a name", file=sys.stderr)
        return 2
    if a.command != "serve" and files.find_manifest(a.root) is None:
        print(f"E0402 no intent.toml in {a.root} or above; init proposes one", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("intentloom").getOrCreate()
    try:
        if a.command == "serve":
            tools = {"ask": lambda x: answer(load(spark, a), x["query"], x.get("all", False), x.get("max_len")), "lint": lambda _: (r[0] for r in sinks.findings_json(load(spark, a, True).findings).collect()), "history": lambda x: history(load(spark, a), a.root, x["qname"]), "stats": lambda _: counts(load(spark, a))}
            server.serve(sys.stdin, sys.stdout, tools)
            return 0
        g = load(spark, a, a.command == "lint" and not a.no_stale)
        if a.command == "scan":
            rows = sinks.blocks_json(g)
        elif a.command == "lint":
            rows = (sinks.finding_line(r) for r in sinks.in_order(g.findings).toLocalIterator()) if a.human else (r[0] for r in sinks.findings_json(g.findings).toLocalIterator())
        elif a.command == "ask":
            rows = answer(g, a.what, a.all, a.max_len, a.human)
        elif a.command == "history":
            rows = history(g, a.root, a.what, a.human)
        elif a.command == "stats":
            rows = counts(g)
        else:
            rows = sinks.dot(g, T.neighbourhood(g, plan.lookup(g, a.focus), a.depth) if a.focus else None)
        for r in rows:
            print(r)
        return int(a.command == "lint" and g.findings.filter("severity = 'error'").count() > 0)
    except (QueryError, files.ManifestError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="intentloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("what", nargs="?", help="a question (ask) or a name (history)")
    p.add_argument("--root", default=".")
    p.add_argument("--human", action="store_true", help="lines to read in place of JSON")
    p.add_argument("--all", action="store_true", help="all simple paths, of a path question")
    p.add_argument("--max-len", type=int)
    p.add_argument("--focus", help="dot: only what is near this node")
    p.add_argument("--depth", type=int, default=1)
    p.add_argument("--no-stale", action="store_true", help="lint: don't ask git what changed after its block")
    p.add_argument("--no-cache", action="store_true")
    a = p.parse_args(argv)
    try:
        return run(a)
    except Exception as e:  # noqa: BLE001
        print(f"internal error: {type(e).__name__}: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())

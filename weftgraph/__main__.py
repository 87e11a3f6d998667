"""``python -m weftgraph FOLDER VERB ...``: questions to a graph kept in a folder, answered as JSON lines."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time
from datetime import UTC, datetime


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    parser.add_argument("folder")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str, parent=verbs, **flags) -> argparse.ArgumentParser:
        one = parent.add_parser(name)
        for p in positional:
            one.add_argument(p)
        for flag, kind in flags.items():
            flag = "--" + flag.replace("_", "-")
            if kind is bool:
                one.add_argument(flag, action="store_true")
            elif kind is list:
                one.add_argument(flag, action="append", default=[])
            elif isinstance(kind, type):
                one.add_argument(flag, type=kind)
            else:
                one.add_argument(flag, type=type(kind), default=kind)
        return one

    for name in ("find", "neighbors", "deps"):
        verb(name, "term")
    verb("impact", "term", depth=4)
    verb("basis", "a", "b", hops=3)
    for name in ("candidates", "search"):
        verb(name, "text", k=10, label=list)
    verb("query", "statement", write=bool)
    verb("index", "project", manifest=str, no_communities=bool, force=bool)
    verb("status", "project", manifest=str)
    verb("watch", "project", manifest=str, every=0.8, rounds=int)
    verb("community")
    verb("reflect", min_confidence=0.5)
    verb("gaps", limit=15, exclude=list)
    sem = verbs.add_parser("sem").add_subparsers(dest="action", required=True)
    verb("ls", parent=sem, all=bool)
    verb("review", parent=sem)
    add = verb("add", "rel", "a", "b", parent=sem, confidence=float, why=str, author="llm", supersede=bool, require_basis=bool, basis_hops=3)
    add.add_argument("--commit", default=None)
    verb("confirm", "rel", "a", "b", parent=sem)
    concept = verbs.add_parser("concept").add_subparsers(dest="action", required=True)
    verb("add", "name", parent=concept, summary=str)
    return parser


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def _commit() -> str | None:
    """The commit of the working folder, where there is one."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except OSError:
        return None


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)

    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .plans.runtime import Scratch
    from .plans.session import GraphSession

    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    graph = GraphSession(spark, args.folder)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))

    def show(rows) -> None:
        for line in rows.toJSON().toLocalIterator():
            print(line)

    def lists(parts: dict) -> None:
        """A line of counts, and then a line for each row of each list."""
        scratch = Scratch(spark, "lists")
        held = {name: scratch.write(rows) for name, rows in parts.items()}
        say({"summary": {name: rows.count() for name, rows in held.items()}})
        for name, rows in held.items():
            for line in rows.toJSON().toLocalIterator():
                print(f'{{"list": "{name}", "row": {line}}}')

    def watch() -> None:
        done = 0
        while args.rounds is None or done < args.rounds:
            found = graph.index(args.project, _now(), args.manifest)
            if not found.get("up_to_date"):
                say(found)
            done += 1
            time.sleep(args.every)

    def ask() -> None:
        tier, rows = graph.ask(args.text, _now(), args.k, tuple(args.label))
        say(tier)
        show(rows)

    act = {
        "find": lambda: show(graph.find(args.term)), "neighbors": lambda: show(graph.neighbors(args.term)), "deps": lambda: show(graph.deps(args.term)),
        "impact": lambda: show(graph.impact(args.term, args.depth)), "basis": lambda: say({"hops": graph.basis(args.a, args.b, args.hops)}),
        "candidates": ask, "search": lambda: show(graph.search(args.text, args.k, tuple(args.label))),
        "query": lambda: show(graph.query(args.statement, write=args.write)),
        "index": lambda: say(graph.index(args.project, _now(), args.manifest, not args.no_communities, args.force)),
        "status": lambda: say(graph.status(args.project, args.manifest)), "watch": watch, "community": lambda: say({"communities": graph.community()}),
        "reflect": lambda: lists(graph.reflect(args.min_confidence)), "gaps": lambda: lists(graph.gaps(args.limit, tuple(args.exclude))),
        "sem ls": lambda: show(graph.semantic(args.all)), "sem review": lambda: show(graph.review_queue()),
        "sem add": lambda: graph.add_semantic(args.rel, args.a, args.b, _now(), args.confidence, args.why, args.author, args.supersede, args.require_basis, args.commit or _commit(), args.basis_hops),
        "sem confirm": lambda: say({"confirmed": graph.confirm(args.rel, args.a, args.b, _now())}),
        "concept add": lambda: say({"key": graph.add_concept(args.name, args.summary)}),
    }[f"{args.verb} {args.action}" if args.verb in ("sem", "concept") else args.verb]
    try:
        act()
    except (ValueError, PySparkException) as error:
        print(json.dumps({"error": str(error)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

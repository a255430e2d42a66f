"""Command line: run programs, load tables, ingest documents, look at a store."""

from __future__ import annotations

import argparse
import os
import sys

from rolegraph.catalog import Catalog
from rolegraph.lang.canonical import canonical
from rolegraph.lang.tree import ProgramError


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rolegraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _store(args, lock: bool = True):
    from rolegraph.store.store import Store

    return Store(_spark(), args.db, Catalog.standard(), lock)


def stats(store) -> str:
    m = store.manifest
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(store.path) for f in files)
    lines = [f"position {m['pos']}, {len(m['segments'])} segments, {size / 1e6:.1f} MB on disk"]
    lines += [f"{c}: {n} nodes made" for c, n in sorted(m["classes"].items())]
    lines += [f"{k}: {n} records" for k, n in sorted(m["ops"].items())]
    return "\n".join(lines)


def _repl(session) -> int:
    print("an empty line runs what was typed; end with ctrl-d")
    held: list[str] = []
    for line in sys.stdin:
        if line.strip():
            held.append(line.rstrip("\n"))
        elif held:
            print(session.run("\n".join(held)))
            held = []
    if held:
        print(session.run("\n".join(held)))
    return 0


def _playbook(session, args) -> int:
    """Compile a book; what it would change is shown first."""
    from rolegraph.ingest.playbook import compile_book
    from rolegraph.ingest.runners import runner

    if (args.book is None) == (args.runner is None):
        raise ProgramError("name a book or a runner that writes one")
    if args.book is not None:
        with open(args.book, encoding="utf-8") as f:
            text = f.read()
    ask = runner(args.runner) if args.runner else None

    def write(error: str | None) -> str:
        if ask is None:
            if error:
                raise ProgramError(error)
            return text
        prompt = "Write a schema book with the blocks schema, aliases and examples for this graph:\n" + session.graph.catalog.listing()
        return ask(prompt + (f"\nThe last try failed: {error}" if error else ""))

    def confirm(plan) -> bool:
        print(plan)
        return args.yes or input("apply? [y/N] ").strip().lower() in ("y", "yes")

    print("applied" if compile_book(session, write, confirm) else "left as it was")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="rolegraph")
    sub = top.add_subparsers(dest="verb", required=True)
    for verb in ("run", "repl", "stats", "ingest", "load-nodes", "load-edges", "sweep"):
        p = sub.add_parser(verb)
        p.add_argument("--db", required=True)
        if verb == "run":
            p.add_argument("program", help="a program, or - for standard input")
        if verb == "ingest":
            p.add_argument("path")
        if verb == "load-nodes":
            p.add_argument("path")
            p.add_argument("cls")
        if verb == "load-edges":
            p.add_argument("path")
            p.add_argument("edge")
            p.add_argument("roles", nargs=2, help="role=column")
    p = sub.add_parser("extract", help="facts out of a staged document's chunks")
    p.add_argument("--db", required=True)
    p.add_argument("document", help="the document's node id")
    p.add_argument("--runner", required=True, help="what answers prompts, as in command:PROGRAM")
    p = sub.add_parser("playbook", help="apply a schema book, from a file or written by a runner")
    p.add_argument("--db", required=True)
    p.add_argument("book", nargs="?")
    p.add_argument("--runner")
    p.add_argument("--yes", action="store_true", help="apply without asking")
    p = sub.add_parser("replay", help="hold recorded results against the store")
    p.add_argument("--db", required=True)
    p.add_argument("path")
    p = sub.add_parser("canonical")
    p.add_argument("program")
    args = top.parse_args(argv)
    try:
        if args.verb == "canonical":
            print(canonical(sys.stdin.read() if args.program == "-" else args.program))
            return 0
        from rolegraph.session import Session

        with _store(args, lock=args.verb not in ("stats", "replay")) as store:
            if args.verb == "run":
                print(Session(store).execute(sys.stdin.read() if args.program == "-" else args.program))
            elif args.verb == "repl":
                return _repl(Session(store))
            elif args.verb == "stats":
                print(stats(store))
            elif args.verb == "ingest":
                from rolegraph.ingest.stage import stage_all

                for file, doc, notes in stage_all(store, args.path):
                    print(file, doc or "skipped", *notes, sep="\t")
            elif args.verb == "extract":
                from rolegraph.ingest.extract import extract
                from rolegraph.ingest.runners import runner

                done = extract(Session(store), args.document, runner(args.runner))
                print(f"{done.done} chunks done, {len(done.failed)} failed, {done.spent} tokens" + (", stopped at the budget" if done.stopped else ""))
            elif args.verb == "playbook":
                return _playbook(Session(store), args)
            elif args.verb == "replay":
                from rolegraph.audit import replay

                r = replay(Session(store), args.path)
                print(f"{r.right} right, {len(r.wrong)} wrong, {len(r.failed)} failed", *r.wrong, sep="\n")
                return int(bool(r.wrong or r.failed))
            elif args.verb == "load-nodes":
                from rolegraph.sources.bulk import load_nodes

                print(f"{load_nodes(store, args.path, args.cls)} nodes")
            elif args.verb == "load-edges":
                from rolegraph.sources.bulk import load_edges

                n, notes = load_edges(store, args.path, args.edge, dict(r.split("=", 1) for r in args.roles))
                print(f"{n} edges", *notes, sep="\n")
            elif args.verb == "sweep":
                from rolegraph.store.writes import sweep

                print(f"{sweep(store)} new candidates")
        return 0
    except ProgramError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

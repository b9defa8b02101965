"""python -m shelfscan --db FOLDER index|find|search|name|dupes|stats|roots|tree|hash|watch|schedule|vacuum|clear ..."""

from __future__ import annotations

import argparse
import sys
import time

from shelfscan.functions.schedule import parse_hours
from shelfscan.index import Index
from shelfscan.operators.fts import SyntaxProblem
from shelfscan.plans.search import records
from shelfscan.session import get_spark, scratch
from shelfscan.sources.sinks import write_results


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="shelfscan")
    ap.add_argument("--db", default="shelfscan-index")
    sub = ap.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("roots", nargs="*")
    for flag in ("--rebuild", "--include-cloud", "--ocr"):
        p.add_argument(flag, action="store_true")
    for name, argument, limit in (("find", "query", 50), ("search", "query", 25), ("name", "pattern", 50)):
        p = sub.add_parser(name)
        p.add_argument(argument)
        p.add_argument("-n", "--limit", type=int, default=limit)
        p.add_argument("-e", "--ext", nargs="+")
    p = sub.add_parser("dupes")
    p.add_argument("-n", "--limit", type=int, default=0)
    p.add_argument("-e", "--ext", nargs="+")
    for mode in ("exact", "near", "images"):
        p.add_argument(f"--{mode}", action="store_const", const=mode, dest="mode", default="name")
    p.add_argument("--distance", type=int)
    p.add_argument("--under")
    p.add_argument("--no-hash", action="store_true")
    for name in ("find", "search", "name", "dupes"):
        sub.choices[name].add_argument("-o", "--out")
        sub.choices[name].add_argument("-f", "--format", choices=("csv", "json", "txt"), default="csv")
    p = sub.add_parser("roots")
    p.add_argument("--add", nargs="+")
    p.add_argument("--forget", nargs="+")
    p.add_argument("--restamp", action="store_true")
    p = sub.add_parser("tree")
    p.add_argument("-o", "--out", default="tree.txt")
    p.add_argument("-f", "--format", choices=("txt", "csv", "json"), default="txt")
    p.add_argument("--under")
    p = sub.add_parser("hash")
    p.add_argument("--mode", choices=("dupes", "all", "full"), default="dupes")
    p.add_argument("--near", action="store_true")
    p.add_argument("--under")
    p = sub.add_parser("watch")
    p.add_argument("--every", type=float, default=2.0)
    p.add_argument("--ticks", type=int, default=0, help="0: until stopped")
    p = sub.add_parser("schedule")
    p.add_argument("--every", default="24h")
    p.add_argument("--runs", type=int, default=0, help="0: until stopped")
    for name in ("stats", "vacuum", "clear"):
        sub.add_parser(name)
    return ap


def main(argv: list[str] | None = None) -> int:
    """0; 1 if a query is no expression; 2 if there is nothing to draw; 3 if another run holds the index."""
    a = parser().parse_args(argv)
    index = Index(get_spark(), a.db)
    with scratch(index.spark):
        return run(a, index)


def run(a: argparse.Namespace, index: Index) -> int:
    try:
        if a.command == "index":
            for action, n in index.refresh(a.roots or None, a.rebuild, a.include_cloud, a.ocr).items():
                print(action, n)
        elif a.command in ("find", "search", "name", "dupes"):
            group = None
            if a.command == "find":
                text = a.query + (" ext:" + ";".join(a.ext) if a.ext else "")
                rows = records(index.find(text, a.limit))
            elif a.command == "search":
                rows = records(index.search(a.query, a.limit, a.ext))
            elif a.command == "name":
                rows = records(index.name(a.pattern, a.limit, a.ext))
            else:
                rows, group = index.dupe_records(a.mode, a.limit, a.under, a.ext, a.distance, not a.no_hash), "set"
            if a.out:
                print(write_results(rows, a.out, a.format, group), "records")
            else:
                for r in rows.toLocalIterator():
                    print(*("" if v is None else v for v in r), sep="\t")
        elif a.command == "stats":
            for name, df in index.stats().items():
                print(name)
                for r in df.toLocalIterator():
                    print("  ", *r)
        elif a.command == "roots":
            if a.add:
                index.remember(a.add)
            if a.forget:
                index.forget_roots(a.forget)
            if a.restamp:
                index.restamp()
            for r in index.roots.orderBy("added", "path").toLocalIterator():
                print(r["path"], r["last_index"])
        elif a.command == "tree":
            if not index.files.limit(1).count():
                print("the index is empty", file=sys.stderr)
                return 2
            index.tree(a.out, a.format, a.under)
        elif a.command == "hash":
            index.hash(a.mode, a.under)
            if a.near:
                index.fingerprint_texts()
        elif a.command == "watch":
            from shelfscan.streaming.watch import follow

            follow(index, a.every, a.ticks)
        elif a.command == "schedule":
            hours, runs = parse_hours(a.every), 0
            while not a.runs or runs < a.runs:
                time.sleep(hours * 3600 if runs else 0)
                index.refresh()
                runs += 1
        else:
            getattr(index, a.command)()
    except SyntaxProblem as problem:
        print(problem, file=sys.stderr)
        return 1
    except BlockingIOError as problem:
        print(problem, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m ctxloom.cli COMMAND: init, index, doctor, find, neighbors, impact, pack, bench, rules."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from ctxloom.operators.rank import render_pack
from ctxloom.sources import files as FS
from ctxloom.sources.rules import merged, rules_toml


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ctxloom")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("init")
    a.add_argument("repos", nargs="+")
    a.add_argument("--force", action="store_true")
    a = sub.add_parser("index")
    a.add_argument("--rebuild", action="store_true")
    sub.add_parser("doctor")
    a = sub.add_parser("find")
    a.add_argument("query")
    a.add_argument("--limit", type=int, default=20)
    for name in ("neighbors", "impact"):
        sub.add_parser(name).add_argument("node")
    a = sub.add_parser("pack")
    a.add_argument("task")
    a.add_argument("--budget", type=int, default=4000)
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("bench")
    a.add_argument("tasks")
    a.add_argument("--budget", type=int, default=4000)
    sub.add_parser("rules")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "init":
        print(FS.init(".", a.repos, force=a.force))
        return 0
    path = a.config or FS.find_config(".")
    if a.command == "rules":
        print(rules_toml(merged(FS.load_config(path).framework if path else None)))
        return 0
    if not path:
        print("no ctxloom.toml here or above; run init first", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from ctxloom.api import ContextGraph

    g = ContextGraph(SparkSession.builder.appName("ctxloom").getOrCreate(), str(Path(path).parent.resolve() / ".ctxloom"), FS.load_config(path))
    if a.command == "index":
        if a.rebuild:
            g.store.clear()
        print(json.dumps(g.index(), indent=1))
    elif a.command == "pack":
        found = g.pack(a.task, a.budget)
        print(json.dumps(found, ensure_ascii=False) if a.json else render_pack(found))
    else:
        df = {"doctor": g.doctor, "find": lambda: g.search(a.query, a.limit), "neighbors": lambda: g.neighbors(a.node), "impact": lambda: g.impact(a.node), "bench": lambda: g.bench(FS.read_tasks(g.spark, a.tasks), a.budget)}[a.command]()
        for row in df.toLocalIterator():
            print(json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

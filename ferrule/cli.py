"""python -m ferrule.cli: analyze, scan, stats, list, slice."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ferrule.operators.serving import find_unguarded_sinks, get_path_slice, list_paths
from ferrule.plans.project import analyze_ingest, analyze_project, call_statistics, export, scan_lines
from ferrule.sources.files import file_hashes, read_tree, source_lines
from ferrule.sources.rules import load_rules


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ferrule")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "scan", "stats"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--rules", help="a pack or a folder of packs, in place of those that come along")
        if name == "analyze":
            s.add_argument("--out", default="ferrule-out")
            s.add_argument("--sarif", action="append", default=[])
            s.add_argument("--semgrep", action="append", default=[])
    s = sub.add_parser("list")
    s.add_argument("out")
    for a in ("--layer", "--min-confidence", "--file"):
        s.add_argument(a)
    s.add_argument("--limit", type=int, default=50)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--unguarded", action="store_true")
    s = sub.add_parser("slice")
    s.add_argument("out")
    s.add_argument("path")
    s.add_argument("id")
    s.add_argument("--around", type=int, default=3)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("ferrule").getOrCreate()
    try:
        if a.command in ("analyze", "scan", "stats"):
            rules = load_rules(a.rules) if a.rules else None
            if a.command == "analyze" and (a.sarif or a.semgrep):
                r = analyze_ingest(spark, a.path, a.sarif, a.semgrep, rules)
            else:
                r = analyze_project(spark, a.path, rules)
            if a.command == "analyze":
                export(r, a.out, a.path, {"mode": "ingest" if a.sarif or a.semgrep else "builtin"})
                print(r.counts())
            elif a.command == "scan":
                for x in scan_lines(r.findings).toLocalIterator():
                    print(x.line)
            else:
                for df in call_statistics(r):
                    df.show(truncate=False)
            return 0
        findings = spark.read.parquet(f"{a.out}/findings")
        if a.command == "list":
            rows, total = find_unguarded_sinks(findings, a.layer) if a.unguarded else list_paths(findings, a.layer, a.min_confidence, a.file, a.limit, a.offset)
            rows.show(a.limit, truncate=False)
            total.show()
        else:
            tree = read_tree(spark, a.path)
            get_path_slice(findings, a.id, source_lines(tree), file_hashes(tree), a.around).show(1000, truncate=False)
        return 0
    except ValueError as e:
        print(f"error: {e}")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: scan, anonymize, verify, info and convert (which plans, as there is no codec)."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sablelens.functions.rules import RuleSet
from sablelens.operators import convert as C
from sablelens.operators import report as G
from sablelens.operators.anonymize import anonymize, verified
from sablelens.operators.durable import kept
from sablelens.operators.scan import scan
from sablelens.sources import files as S


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sablelens")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "anonymize", "verify", "info", "convert"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--format")
        p.add_argument("--patterns", help="JSON file of further rules")
        p.add_argument("-v", "--verbose", action="store_true")
        if name != "info":
            p.add_argument("-w", "--workers", type=int, help="local cores to use where no cluster is configured")
        if name == "convert":
            p.add_argument("-o", "--output", required=True)
            p.add_argument("-t", "--target-format", choices=list(C.TARGETS), default="tiff")
        if name == "scan":
            p.add_argument("-i", "--institution", default="")
            p.add_argument("--json-out")
            p.add_argument("-r", "--report")
        if name == "anonymize":
            p.add_argument("-o", "--output")
            p.add_argument("--in-place", action="store_true")
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("-c", "--certificate")
            p.add_argument("-i", "--institution", default="")
            p.add_argument("--no-verify", action="store_true")
            p.add_argument("--verify-integrity", action="store_true")
            p.add_argument("--checksum", action="store_true", help="print the SHA-256 of every output")
            p.add_argument("--reset-timestamps", action=argparse.BooleanOptionalAction, default=True)
            p.add_argument("--log", help="file for a line about each file")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("sablelens")
        spark = (builder.master(f"local[{args.workers}]") if getattr(args, "workers", None) else builder).getOrCreate()
    rules = RuleSet.from_json(Path(args.patterns).read_text()) if args.patterns else RuleSet()
    if args.command == "scan":
        _, findings, results = scan(spark, args.path, args.format, rules)
        summary = G.scan_summary(results).first().asDict()
        print(json.dumps(summary))
        rows = [r.asDict() for r in findings.orderBy("path", "phase", "offset").toLocalIterator()] if args.verbose or args.json_out or args.report else []
        if args.verbose:
            for r in rows:
                print(f"{r['path']}: {r['tag_name']} at {r['offset']}: {r['value_preview']}")
        if args.json_out:
            Path(args.json_out).write_text(json.dumps(rows, indent=2))
        if args.report:
            Path(args.report).write_text(G.markdown("Scan", summary | ({"institution": args.institution} if args.institution else {}), rows))
        return 0
    if args.command == "anonymize":
        if not (args.output or args.in_place or args.dry_run):
            print("give --output, --in-place or --dry-run", file=sys.stderr)
            return 1
        if args.dry_run:
            anonymize(spark, args.path, args.path, args.format, rules, dry_run=True).drop("payload").orderBy("path", "offset").show(1000, False)
            return 0
        output = args.path if args.in_place else args.output
        if not args.in_place:
            found = S.list_files(S.walk(spark, args.path), args.format)
            there = next(p for p in (Path(output), *Path(output).resolve().parents) if p.exists())
            problems = G.preflight(found, output, shutil.disk_usage(there).free).collect()
            for r in problems:
                print(f"{r['level']}: {r['message']}", file=sys.stderr)
            if any(r["level"] == "error" and not r["message"].startswith("Cannot read") for r in problems):
                return 1
            Path(output).mkdir(parents=True, exist_ok=True)
        results = kept(anonymize(spark, args.path, output, args.format, rules, verify=not args.no_verify, check_images=args.verify_integrity, reset_timestamps=args.reset_timestamps))
        stats = G.batch_stats(results).first().asDict()
        print(json.dumps(stats))
        if args.checksum:
            for r in results.where("sha256_after IS NOT NULL").orderBy("output").toLocalIterator():
                print(f"{r['sha256_after']}  {r['output']}")
        if args.log:
            with open(args.log, "a") as log:
                log.writelines(r["line"] + "\n" for r in G.result_log(results).toLocalIterator())
        if args.certificate:
            Path(args.certificate).write_text(G.certificate(results, args.institution, "inplace" if args.in_place else "copy", args.reset_timestamps))
        return int(stats["errored"] > 0)
    if args.command == "verify":
        rows = verified(spark, args.path, args.format, rules)
        dirty = rows.where("NOT clean").count()
        print(json.dumps({"clean": rows.where("clean").count(), "dirty": dirty}))
        return int(dirty > 0)
    if args.command == "convert":
        for r in C.plan(S.list_files(S.walk(spark, args.path), args.format), args.output, args.target_format).orderBy("path").toLocalIterator():
            print(f"{r['path']} -> {r['output']}")
        print("no codec is at hand: nothing was converted", file=sys.stderr)
        return 1
    if Path(args.path).is_dir():
        print("info takes a file", file=sys.stderr)
        return 1
    from sablelens.operators.info import info

    print(json.dumps(info(spark, args.path), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())

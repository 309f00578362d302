"""python -m lexiloom.commands: translate, verify, adopt, tm, filenames, list."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import filenames, lineage, memory
from .plans import job, translate
from .sources import interchange
from .sources.formats import FORMATS

#: Providers by name. Others are added by the program that uses the library; none here needs a network.
PROVIDERS = {"wrap": translate.Wrapping}


def _print(rows) -> None:
    for row in rows.toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False, default=str))


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiloom")
    top.add_argument("--memory", default=os.path.expanduser("~/.lexiloom/memory"))
    commands = top.add_subparsers(dest="command", required=True)
    t = commands.add_parser("translate")
    t.add_argument("-i", "--input", required=True)
    t.add_argument("-o", "--output")
    t.add_argument("-e", "--format", default="auto")
    t.add_argument("-t", "--provider", default="wrap", choices=sorted(PROVIDERS))
    t.add_argument("-s", "--source", default="auto")
    t.add_argument("-d", "--target", required=True)
    t.add_argument("--opt", action="append", default=[], metavar="KEY=VALUE")
    for flag in ("--memory-only", "--switch-engine", "--dry-run", "--review"):
        t.add_argument(flag, action="store_true")
    t.add_argument("--incremental", action=argparse.BooleanOptionalAction, default=True)
    v = commands.add_parser("verify")
    v.add_argument("folder")
    v.add_argument("--original")
    a = commands.add_parser("adopt")
    a.add_argument("folder")
    a.add_argument("--original", required=True)
    a.add_argument("-e", "--format", default="json", choices=sorted(FORMATS))
    m = commands.add_parser("tm")
    m.add_argument("action", nargs="?", default="count", choices=("count", "export", "import", "glossary", "repair", "migrate-legacy"))
    m.add_argument("path", nargs="?")
    m.add_argument("-s", "--source", default="en")
    m.add_argument("-d", "--target", default="pt")
    m.add_argument("--status", default="")
    m.add_argument("--engine", default="human")
    m.add_argument("--term", nargs=2, metavar=("SOURCE", "TARGET"))
    m.add_argument("--apply", action="store_true")
    f = commands.add_parser("filenames")
    f.add_argument("-i", "--input", required=True)
    f.add_argument("-o", "--output", required=True)
    f.add_argument("-s", "--source", default="en")
    f.add_argument("-d", "--target", required=True)
    f.add_argument("-t", "--provider", default="wrap", choices=sorted(PROVIDERS))
    f.add_argument("--keep-original", action="store_true")
    commands.add_parser("list")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(FORMATS)))
        return 0
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    tm = job.Memory(spark, args.memory)
    return {"translate": _translate, "verify": _verify, "adopt": _adopt, "tm": _tm, "filenames": _filenames}[args.command](spark, args, tm)


def _translate(spark, args, tm) -> int:
    options = tuple(tuple(o.split("=", 1)) for o in args.opt)
    config = job.Config(args.input, args.output or args.input, args.source, args.target, args.provider, args.format, args.memory_only, args.switch_engine, args.incremental, options)
    if args.dry_run:
        _print(job.estimated(spark, config, tm))
        return 0
    code = 0
    try:
        states = job.run(spark, config, tm, PROVIDERS[args.provider](), _reviewed if args.review else None)
    except job.Rejected:
        return 1
    except translate.RateLimited as limit:
        states, code = limit.args[0], 1
    _print(states)
    _print(job.finished(states))
    return code


def _reviewed(folder: str) -> bool:
    """Whether the person at the terminal accepts the files in a folder."""
    return input(f"{folder}: write these files? [y/N] ").strip().lower() in ("y", "yes")


def _verify(spark, args, tm) -> int:
    states = job.verified(spark, args.folder, args.original).persist()
    _print(states.orderBy("rel"))
    _print(lineage.summary(states).orderBy("state"))
    return 0


def _adopt(spark, args, tm) -> int:
    print(json.dumps(job.recorded(spark, args.folder, args.original, FORMATS[args.format].extensions), sort_keys=True))
    return 0


def _tm(spark, args, tm) -> int:
    table = tm.read()
    if args.action == "count":
        print(table.count())
    elif args.action == "export":
        statuses = tuple(s for s in args.status.split(",") if s)
        interchange.write_tmx(memory.pairs(table, args.source, args.target, statuses), args.path, args.source, args.target)
    elif args.action == "import":
        units, skipped = interchange.tmx_units(spark, args.path)
        tm.write(memory.merged(table, interchange.tmx_entries(units, args.engine, args.status or "reviewed"), job.now()))
        _print(skipped)
    elif args.action == "glossary":
        if args.term:
            terms = spark.createDataFrame([(0, args.source, args.target, *args.term)], "ord long, src_lang string, tgt_lang string, source_text string, target_text string")
            tm.write(memory.glossary_locked(table, terms, job.now()))
        else:
            _print(memory.pairs(table.where(F.col("engine") == "glossary"), args.source, args.target).orderBy("min_id"))
    elif args.action == "repair":
        _print(memory.repair_report(table))
        _print(memory.repair_examples(table))
        if args.apply:  # the former state stays in the folder as a backup
            tm.write(memory.repaired(table, job.now()))
    else:
        entries, counts = interchange.legacy_caches(spark, args.path)
        tm.write(memory.merged(table, entries, job.now()))
        _print(counts)
    return 0


def _filenames(spark, args, tm) -> int:
    found = [os.path.relpath(os.path.join(folder, name), args.input) for folder, _, names in os.walk(args.input) for name in sorted(names)]
    rows = [(rel, os.path.dirname(rel), *os.path.splitext(os.path.basename(rel))) for rel in found]
    translated = PROVIDERS[args.provider]().translate([r[2] for r in rows], args.source, args.target)
    df = spark.createDataFrame([(*r, t) for r, t in zip(rows, translated)], "rel string, folder string, stem string, ext string, translated string")
    for row in filenames.allocated(df).toLocalIterator():
        names = {row.target} | ({os.path.basename(row.rel)} if args.keep_original else set())
        for name in names:
            place = os.path.join(args.output, row.folder, name)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            shutil.copy2(os.path.join(args.input, row.rel), place)
    return 0


if __name__ == "__main__":
    sys.exit(main())

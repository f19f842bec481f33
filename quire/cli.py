"""Command line: review and redact pages, and show what is installed.

    python -m quire.cli review PAGES.parquet --top 60 --json OUT
    python -m quire.cli redact PAGES.parquet OUT --hide TERM --detector email,card --style label
    python -m quire.cli info
"""

from __future__ import annotations

import argparse
import importlib.util

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.detectors import PATTERNS
from .operators import redact, scan
from .sources import terms


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="command", required=True)
    review = sub.add_parser("review", help="propose sensitive terms of pages(doc, page, text)")
    review.add_argument("pages")
    review.add_argument("--top", type=int, default=60)
    review.add_argument("--json", help="folder for all candidates as JSON")
    hide = sub.add_parser("redact", help="write pages without the named terms")
    hide.add_argument("pages")
    hide.add_argument("out")
    hide.add_argument("--hide", action="append", default=[])
    hide.add_argument("--regex", action="append", default=[])
    hide.add_argument("--detector", default="")
    hide.add_argument("--terms-file")
    hide.add_argument("--style", choices=("label", "mask", "hash", "remove"), default="label")
    sub.add_parser("info", help="what optional parts are installed")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "info":
        for name in ("pdfplumber", "docx", "openpyxl"):
            print(f"{name}: {'yes' if importlib.util.find_spec(name) else 'no'}")
        return 0
    spark = SparkSession.builder.appName("quire").getOrCreate()
    pages = spark.read.parquet(args.pages).select(F.col("doc"), F.col("page"), F.col("text"))
    if args.command == "review":
        found = scan.scan(pages)
        if args.json:
            found.write.mode("overwrite").json(args.json)
        found.orderBy(F.desc("score"), F.desc("count"), "text").limit(args.top).show(args.top, truncate=60)
        return 0
    listed = terms.load(spark, args.terms_file) if args.terms_file else terms.Terms((), (), ())
    detectors = sorted({*filter(None, map(str.strip, args.detector.split(","))), *listed.detectors})
    if unknown := [d for d in detectors if d not in PATTERNS]:
        raise SystemExit(f"unknown detector: {', '.join(unknown)}")
    wanted = (*args.hide, *listed.terms)
    rules = redact.build_rules(wanted, detectors, (*args.regex, *listed.patterns))
    if args.style == "label":
        clean, entities = redact.label(pages, rules)
        redact.report(entities).write.mode("overwrite").parquet(f"{args.out}-report")
    else:
        clean = pages.withColumn("text", redact.scrub(F.col("text"), rules, args.style))
    clean.write.mode("overwrite").parquet(args.out)
    left = redact.leaks(spark.read.parquet(args.out), wanted).where("size(leaked) > 0").count() if wanted else 0
    if left:
        print(f"{left} pages still hold a listed term")
    return int(left > 0)


if __name__ == "__main__":
    raise SystemExit(main())

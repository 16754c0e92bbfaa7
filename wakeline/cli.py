"""Command line: ingest CSV, write layouts, run the query set or SQL on them, sweep settings, roll up identities."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from wakeline.operators.identities import identities, write_identities
from wakeline.plans import sweep
from wakeline.plans.planner import describe, plan
from wakeline.plans.queryset import queries
from wakeline.reporting import as_json, check_consistency, markdown, timed
from wakeline.sources.csv_ingest import ingest, read_lines, skipped_lines
from wakeline.sources.layouts import LAYOUTS, SOURCE, bloom_columns, footers, parse_ndv, read_layout, write_layouts

log = logging.getLogger("wakeline")

#: Session settings; ``--set`` overrides them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.filterPushdown.string.startsWith": "true",
    "spark.sql.parquet.enableVectorizedReader": "true",
}


def setting(text: str) -> tuple[str, str]:
    """``KEY=VALUE``."""
    key, sign, value = text.partition("=")
    if not key or not sign:
        raise ValueError(f"not KEY=VALUE: {text!r}")
    return key, value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wakeline")
    p.add_argument("--set", type=setting, action="append", default=[], metavar="KEY=VALUE", help="a session setting")
    p.add_argument("--quiet", action="store_true", help="no progress lines")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="CSV folder to one typed Parquet table")
    a.add_argument("csv"), a.add_argument("out")
    a.add_argument("--max-rows", type=int)
    a.add_argument("--row-group-rows", type=int, default=SOURCE.row_group_rows)
    a.add_argument("--page-bytes", type=int, default=SOURCE.page_bytes)
    a.add_argument("--compression-level", type=int, default=SOURCE.compression_level)
    b = sub.add_parser("layouts", help="write layouts of a typed table")
    b.add_argument("source"), b.add_argument("folder")
    b.add_argument("--only", choices=LAYOUTS, action="append")
    b.add_argument("--bloom", action="append", default=[], help="another column with a bloom filter")
    b.add_argument("--row-group-rows", type=int, default=1_000_000)
    b.add_argument("--smart-row-groups", action="store_true")
    b.add_argument("--page-bytes", type=int, default=0)
    b.add_argument("--compression-level", type=int, default=6)
    b.add_argument("--bloom-fpp", type=float, default=0.01)
    b.add_argument("--bloom-ndv", type=int, default=1_000_000)
    b.add_argument("--bloom-ndv-of", type=parse_ndv, action="append", default=[], metavar="COLUMN=NDV")
    c = sub.add_parser("queries", help="time the query set on layouts")
    c.add_argument("folder")
    c.add_argument("--only", action="append")
    c.add_argument("--repeats", type=int, default=2)
    c.add_argument("--warmups", type=int, default=1)
    c.add_argument("--timeout", type=float, default=300)
    c.add_argument("--json")
    c.add_argument("--markdown")
    d = sub.add_parser("identities", help="roll positions up by identity")
    d.add_argument("source"), d.add_argument("out")
    d.add_argument("--whole", action="store_true", help="one row for each identity, however long its track, instead of one a day")
    e = sub.add_parser("sql", help="a statement over layouts, each a view of its name")
    e.add_argument("folder"), e.add_argument("statement")
    e.add_argument("--only", choices=LAYOUTS, action="append")
    f = sub.add_parser("plans", help="what the query set's plans consist of")
    f.add_argument("folder")
    f.add_argument("--only", choices=LAYOUTS, action="append")
    g = sub.add_parser("sweep", help="time the query set over layout settings and report")
    g.add_argument("source"), g.add_argument("folder")
    g.add_argument("--repeats", type=int, default=2)
    g.add_argument("--warmups", type=int, default=1)
    g.add_argument("--markdown")
    for x in (a, b, d):
        x.add_argument("--overwrite", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(message)s")
    log.setLevel(logging.WARNING if args.quiet else logging.INFO)
    spark = SparkSession.builder.config(map=SETTINGS | dict(args.set)).getOrCreate()
    mode = "overwrite" if getattr(args, "overwrite", False) else "errorifexists"
    if args.command == "ingest":
        options = replace(SOURCE, row_group_rows=args.row_group_rows, page_bytes=args.page_bytes, compression_level=args.compression_level).writer_options()
        log.info("source: reading %s", args.csv)
        ingest(spark, args.csv, args.max_rows).write.mode(mode).options(**options).parquet(args.out)
        if not args.quiet:
            skipped_lines(read_lines(spark, args.csv)).orderBy("file").show(20, truncate=80)
    elif args.command == "layouts":
        options = {
            "row_group_rows": args.row_group_rows, "page_bytes": args.page_bytes, "compression_level": args.compression_level,
            "bloom_fpp": args.bloom_fpp, "bloom_ndv": args.bloom_ndv, "bloom_ndv_by_column": dict(args.bloom_ndv_of),
        }
        chosen = [replace(LAYOUTS[n], **options) for n in args.only or LAYOUTS]
        chosen = [replace(x, blooms=bloom_columns(*args.bloom)) if x.blooms else x for x in chosen]
        write_layouts(spark.read.parquet(args.source), args.folder, chosen, args.overwrite, args.smart_row_groups)
    elif args.command == "queries":
        done = []
        for name in args.only or LAYOUTS:
            path = f"{args.folder}/{name}"
            df, layout = read_layout(spark, path)
            by_footers, _ = read_layout(footers(spark), path)
            for n, q in enumerate(queries(), 1):
                log.info("%s: query %d, %s", name, n, q.name)
                own = df if q.filters or q.operation != "count" else by_footers
                done.append(timed(spark, q.name, name, lambda q=q, df=own, layout=layout: _count(plan(df, q, layout), q.operation), args.repeats, args.warmups, args.timeout))
        for path, text in ((args.json, as_json(done)), (args.markdown, markdown(done))):
            if path:
                with open(path, "w", encoding="utf-8") as f:
                    f.write(text)
        print(markdown(done))
        check_consistency(done)
    elif args.command == "sql":
        for name in args.only or LAYOUTS:
            read_layout(spark, f"{args.folder}/{name}", view=name)
        spark.sql(args.statement).show(1000, truncate=False)
    elif args.command == "plans":
        for name in args.only or LAYOUTS:
            _, layout = read_layout(spark, f"{args.folder}/{name}")
            for q in queries():
                print(f"{name}, {q.name}: " + "; ".join(describe(q, layout)))
    elif args.command == "sweep":
        sweep.run(spark, spark.read.parquet(args.source), args.folder, repeats=args.repeats, warmups=args.warmups)
        text = sweep.report(spark, args.folder)
        print(text)
        if args.markdown:
            with open(args.markdown, "w", encoding="utf-8") as f:
                f.write(text)
    else:
        write_identities(identities(spark.read.parquet(args.source), daily=not args.whole), args.out, mode)


def _count(df, operation: str) -> int:
    return df.count() if operation == "rows" else df.first()["n"]


if __name__ == "__main__":
    main()

"""Command line: ``python -m quillframe run|parse|check|report|scaffold|ingest|import|query ...``."""

from __future__ import annotations

import argparse
import pathlib
import sys

from pyspark.sql import functions as F

from quillframe.plans import jobs, registry
from quillframe.session import local_session
from quillframe.sources import readers


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quillframe")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in {"run": ("texts", "out"), "parse": ("texts", "out"), "check": ("records", "out"), "report": ("parsed", "routed"), "scaffold": ("routed", "out"), "ingest": ("inbox", "out"), "import": ("manifest", "files", "catalog", "out"), "query": ("name", "tables")}.items():
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
        if name in ("run", "parse", "check", "ingest"):
            command.add_argument("--schema", type=pathlib.Path, help="a JSON Schema that records must meet")
        if name == "ingest":
            command.add_argument("--force", action="store_true", help="take known contents again")
            command.add_argument("--archive", action="store_true", help="move the files that were taken to OUT/archive")
        if name == "import":
            command.add_argument("--host", action="append", default=[], help="a host that addresses of the manifest may have")
            command.add_argument("--dry-run", action="store_true", help="count what would be imported")
    args = parser.parse_args(argv)
    spark = local_session()
    read = spark.read.parquet
    schema = args.schema.read_text(encoding="utf-8") if getattr(args, "schema", None) else None
    if args.command == "run":
        jobs.run(spark, args.texts, args.out, schema).show(200, truncate=False)
    elif args.command == "parse":
        unfinished = jobs.parse(spark, args.texts, args.out, schema)
        unfinished.show(200, truncate=False)
    elif args.command == "check":
        jobs.check(spark, read(args.records), args.out, schema).groupBy("route").count().show()
    elif args.command == "report":
        jobs.report(read(args.parsed), read(args.routed)).show(200, truncate=False)
    elif args.command == "scaffold":
        jobs.scaffold(read(args.routed), args.out)
    elif args.command == "ingest":
        jobs.ingest(spark, args.inbox, args.out, args.force, schema, args.archive)
        jobs.archived(spark, args.out).groupBy("status").count().show()
    elif args.command == "import":
        manifest = readers.listed_json(spark, args.manifest, "case_number string, document_type string, url string, file_name string, sha256 string").drop("file", "idx")
        files = readers.read_texts(spark, args.files).select("file_name", "text", F.sha2("text", 256).alias("hash"))
        catalog = read(args.catalog).select("document.case_number", "document.document_type")
        for found in jobs.import_collection(manifest, files, catalog, args.out, args.host, dry_run=args.dry_run):
            found.show(50, truncate=False)
    else:
        registry.QUERIES[args.name](spark, args.tables).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Commands: ``python -m palimpsest FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from palimpsest.plans import workflows
from palimpsest.sources.catalog import Catalog


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    parser.add_argument("folder", help="folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("importdumps", "importlinks"):
        commands.add_parser(name).add_argument("paths", nargs="+")
    for name in ("pagetiers", "network", "evaluate", "export"):
        one = commands.add_parser(name)
        one.add_argument("wiki")
        one.add_argument("instant", help="UTC, as 2018-02-01 00:00:00")
        if name == "export":
            one.add_argument("path")
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog(spark, chosen.folder)
    if chosen.command == "importdumps":
        for path in chosen.paths:
            catalog.import_dump(path)
    elif chosen.command == "importlinks":
        catalog.import_links(*chosen.paths)
    elif chosen.command == "pagetiers":
        workflows.create_tiers(catalog, chosen.wiki, chosen.instant)
    elif chosen.command == "network":
        workflows.extract_network(catalog, chosen.wiki, chosen.instant)
    elif chosen.command == "evaluate":
        workflows.evaluate_network(catalog, chosen.wiki, chosen.instant).orderBy("link_type").show(truncate=False)
    else:
        workflows.export_network(catalog, chosen.wiki, chosen.instant, chosen.path)


if __name__ == "__main__":
    main()

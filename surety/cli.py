"""Query a metric store: ``python -m surety.cli --store URI --start 2010-12-01 --end 2010-12-07 --metrics orders,units``.

The folder holds ``metrics`` (month partitions), ``state.json`` and ``lines-manifest.json``,
as ``store.write_canonical`` and ``store.run_incremental`` leave them.
"""

from __future__ import annotations

import argparse
import csv
import json
import sys
from datetime import date

from surety.operators import store
from surety.session import session
from surety.sources.files import read_json


def main(arguments: list[str] | None = None, out=sys.stdout, spark=None) -> int:
    parser = argparse.ArgumentParser(description="Query a versioned store of daily metrics")
    parser.add_argument("--store", required=True, help="URI of the folder with metrics, state and manifest")
    parser.add_argument("--start", type=date.fromisoformat, required=True)
    parser.add_argument("--end", type=date.fromisoformat, required=True)
    parser.add_argument("--metrics", required=True, help="names, separated by commas")
    parser.add_argument("--format", choices=("json", "csv"), default="json")
    parser.add_argument("--schema-version", choices=list(store.SCHEMAS), default=store.DEFAULT_SCHEMA)
    args = parser.parse_args(arguments)
    names = tuple(x.strip() for x in args.metrics.split(",") if x.strip())
    folder = args.store.rstrip("/")
    with store.MetricStore(spark or session("surety-query"), f"{folder}/metrics", f"{folder}/state.json", read_json(f"{folder}/lines-manifest.json", {})) as served:
        response, _ = served.query(store.MetricQuery(args.start, args.end, names), args.schema_version)
    if args.format == "json":
        out.write(json.dumps(response, indent=2, sort_keys=True) + "\n")
    else:
        rows = csv.DictWriter(out, ["date", *names], lineterminator="\n")
        rows.writeheader()
        rows.writerows(response["data"])
    return 0


if __name__ == "__main__":
    sys.exit(main())

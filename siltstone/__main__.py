"""Command line: index a folder into Parquet tables, or query them.

python -m siltstone index ROOT OUT
python -m siltstone files|exact|graph|pattern OUT '{"...": ...}'
"""

from __future__ import annotations

import json
import os
import shutil
import sys

from siltstone import api
from siltstone.catalog import TABLES, Catalog
from siltstone.session import local_session
from siltstone.sources.indexing import index


def main(arguments: list[str]) -> int:
    if len(arguments) != 3 or arguments[0] not in ("index", "files", "exact", "graph", "pattern"):
        print(__doc__)
        return 2
    command, first, second = arguments
    spark = local_session("*")
    if command == "index":
        known = {n: spark.read.schema(s).parquet(f"{second}/{n}.parquet") for n, s in TABLES.items()} if os.path.isdir(second) else Catalog.empty(spark).tables
        tables, changes = index(spark, first, known)
        # The new state is written beside the old one and then takes its place.
        staged = f"{second.rstrip('/')}.next"
        shutil.rmtree(staged, ignore_errors=True)
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        for name, df in tables.items():
            df.write.parquet(f"{staged}/{name}.parquet")
        shutil.rmtree(second, ignore_errors=True)
        os.rename(staged, second)
        print(json.dumps(counts))
        return 0
    run = {"files": api.files, "exact": api.exact, "graph": api.graph_query, "pattern": api.pattern_query}[command]
    print(json.dumps(run(Catalog.parquet(spark, first, list(TABLES)), json.loads(second)), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
